"""Links of sets of Jaccard similarity ``least`` or more, compared exactly.

Sets of one corpus may be so much alike (the trigrams of long texts of one language)
that no banding keeps them apart and most pairs are candidates. Here no pair is a row:
sets are dealt into buckets of sizes, a bucket meets itself and the next one (others
differ by too much), and blocks of buckets are compared inside a task.

Of sets of a and b items a link needs a symmetric difference of at most
(a + b) * (1 - least) / (1 + least). The parities of a set's items over ``BITS`` hash
places differ in no more places than the sets do in items, and folded ones in fewer
still, so a pair whose folded parities or parities differ in more places is no link;
the others are compared by their items. Nothing that links is left out.

A block yields links enough for its components, not all of them: a pair whose ends
other links already join is not compared, so copies by the thousand cost a link each.
Pairs grow with the square of the rows, at less than 20 ns each; the rows that are shuffled
are two for a set while a bucket fits a block of ``BLOCK_BYTES``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a set's parities, and of folded ones, in words of 64 bits.
WORDS, FINER, FOLDED = 64, 16, 8
BITS = 64 * WORDS
#: Bytes of the sets of a block with their parities, about.
BLOCK_BYTES = 96 << 20
#: Sets that are held against others at a time, and those others.
TILE, WIDE = 32, 4096
#: Sets whose bits are counted at a time.
ROWS = 128


def parities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, WORDS): for each place whether an odd number of a set's items has it."""
    out = np.empty((len(sizes), WORDS), np.uint64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, len(sizes), ROWS):
        n = sizes[at : at + ROWS]
        place = (flat[ends[at] : ends[at + len(n)]] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS.bit_length() + 1)
        odd = np.bincount(np.repeat(np.arange(len(n)) * BITS, n) + place, minlength=len(n) * BITS).astype(np.uint8) & 1
        out[at : at + len(n)] = np.packbits(odd).view(np.uint64).reshape(-1, WORDS)
    return out


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def forest(flat: np.ndarray, sizes: np.ndarray, left: np.ndarray, inside: bool, least: float) -> list[tuple[int, int, float]]:
    """(x, y, similarity) of links that join all sets which links of a left set and a
    right one join, or of two left ones too if ``inside``."""
    slack = (1 - least) / (1 + least) * (1 + 1e-9)
    order = np.argsort(sizes, kind="stable")  # places in it stand for the sets
    starts, bits = (np.cumsum(sizes) - sizes)[order], parities(flat, sizes)[order]
    sizes, left = sizes[order], left[order]
    finer = [_folded(bits, FINER), bits]
    folded = np.ascontiguousarray(_folded(finer[0], FOLDED).T)
    root, found = np.arange(len(sizes)), []
    first = np.searchsorted(sizes, np.ceil(sizes * least * (1 - 1e-9)), "left")
    most = np.minimum(np.ceil(sizes * slack), 64 * FOLDED).astype(np.uint16)  # of a set's part of a link's places
    for at in range(0, len(sizes), TILE):
        # the sets of a tile against those before them, so a pair is met once
        to = min(len(sizes), at + TILE)
        for low in range(int(first[at]), to, WIDE):
            high = min(to, low + WIDE)
            apart = np.zeros((to - at, high - low), np.uint16)
            for k in range(0, FOLDED, 2):  # 128 places fit a byte
                some = np.bitwise_count(folded[k, at:to, None] ^ folded[k, low:high])
                some += np.bitwise_count(folded[k + 1, at:to, None] ^ folded[k + 1, low:high])
                apart += some
            x, y = np.nonzero(apart <= most[at:to, None] + most[low:high])
            x, y = x + at, y + low
            near = (y < x) & (y >= first[x]) & (root[x] != root[y]) & ((left[x] | left[y]) if inside else (left[x] != left[y]))
            x, y = x[near], y[near]
            for words in finer:
                close = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= (sizes[x] + sizes[y]) * slack
                x, y = x[close], y[close]
            for i, j in zip(x.tolist(), y.tolist()):
                if root[i] != root[j]:
                    both = len(np.intersect1d(*(flat[starts[k] : starts[k] + sizes[k]] for k in (i, j)), assume_unique=True))
                    score = both / (int(sizes[i]) + int(sizes[j]) - both)
                    if score >= least:
                        found.append((int(order[i]), int(order[j]), score))
                        root[root == root[i]] = root[j]
    return found


def _block(least: float):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        ids, sizes, left = block.column("id").to_numpy(), block.column("n").to_numpy().astype(np.int64), block.column("role").to_numpy() == 0
        items = pa.concat_arrays(block.column("items").chunks)
        del block  # the items are most of it
        begin = int(np.frombuffer(items.buffers()[1], np.int32)[items.offset])
        flat = np.frombuffer(items.buffers()[2], np.uint32, int(sizes.sum()), begin)
        links = forest(flat, sizes, left, key[1].as_py() == key[2].as_py(), least)
        ends = [[min(ids[i], ids[j]) for i, j, _ in links], [max(ids[i], ids[j]) for i, j, _ in links]]
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64()), "score": pa.array([s for _, _, s in links], pa.float64())})

    return run


def _times(count: Column, *of: Column) -> Column:
    """A row of ``of`` for each number below ``count``, as an array."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(*[f(i) for f in of]))).otherwise(F.array())


def links(sets: DataFrame, least: float) -> DataFrame:
    """a, b, score: links of ``sets`` (id, n, items: the n distinct numbers of 32 bits,
    in order and packed; read twice), enough of them for all components. Empty sets
    have no links."""
    ratio = math.log(1 / least) * 1.001  # a link is in one bucket or in neighbours
    bucket = F.floor(F.log("n") / F.lit(ratio)).cast("int")
    told = sets.where("n > 0").groupBy(bucket.alias("bucket")).agg(F.ceil(F.sum(4 * F.col("n") + 8 * (WORDS + FINER + FOLDED)) / BLOCK_BYTES).cast("int").alias("blocks"))
    of = {r["bucket"]: r["blocks"] for r in told.collect()}  # a row for each size by a quarter
    if not of:
        return sets.sparkSession.createDataFrame([], "a bigint, b bigint, score double")
    blocks = F.create_map(*[F.lit(x) for k, n in sorted(of.items()) for x in (k, n)])
    k, count = F.col("bucket"), lambda at: F.coalesce(F.element_at(blocks, at), F.lit(0))
    rows = sets.where("n > 0").withColumn("bucket", bucket).withColumn("own", F.pmod(F.xxhash64("id"), count(F.col("bucket"))).cast("int"))
    own = F.col("own")
    places = F.concat(
        # left of its bucket's later blocks and of the next bucket's
        F.filter(_times(F.greatest(count(k), count(k + 1)), lambda i: k.alias("k"), lambda i: own.alias("i"), lambda i: i.alias("j"), lambda i: F.lit(0).alias("role")), lambda p: (p["j"] >= own) | (p["j"] < count(k + 1))),
        _times(own, lambda i: k.alias("k"), lambda i: i.alias("i"), lambda i: own.alias("j"), lambda i: F.lit(1).alias("role")),
        _times(count(k - 1), lambda i: (k - 1).alias("k"), lambda i: i.alias("i"), lambda i: own.alias("j"), lambda i: F.lit(1).alias("role")),
    )
    dealt = rows.select("id", "n", "items", F.explode(places).alias("place")).select("place.k", "place.i", "place.j", "place.role", "id", "n", "items")
    return dealt.groupBy("k", "i", "j").applyInArrow(_block(least), "a bigint, b bigint, score double")
