"""SimHash near-duplicates with vantage-point trees.

1. Fingerprints: XXH64 (seed 42) of every word shingle; a bit is set when more
   than half of the shingle hashes have it. One pass, no shuffle.
2. Distinct fingerprints only: copies collapse to the smallest identifier.
3. Partition by Hamming distance: up to ``TREE_ROWS`` fingerprints are one shard.
   More of them are dealt into coarse balls that overlap. The 64 bits fall into
   ``radius + m`` groups; two fingerprints that differ in at most ``radius`` bits
   agree on some ``m`` groups, so for every choice of ``m`` groups a ball of
   distance 0 in the first bits of those groups is a shard, and each linked pair
   meets in at least one. ``m`` and the number of bits are the smallest that
   leave about ``TREE_ROWS / 4`` fingerprints a shard.
4. A shard above ``SHARD_ROWS`` (a crowd of like fingerprints) is cut, round after
   round, into rings around a vantage point; what lies within ``radius`` below a
   ring's inner edge visits it, so no pair is lost. What rings can't part is dealt
   in blocks, and each pair of blocks is a shard.
5. Each shard builds a vantage-point tree over the full distance and searches it
   for all its fingerprints at once: a branch is entered only by those whose ball
   meets its distances from the vantage point (triangle bounds), and taken whole
   by those whose ball holds it.
6. Shards give spanning links (never all pairs), which the star algorithm of
   ``components`` joins with checkpoints between rounds.

Rows of a fingerprint or edges of a vertex that many others share are joined by
a broadcast of bounded size (``join_groups``), not dealt to one task.

Defined results: null text counts as empty; texts with no words have
fingerprint zero and link like any other; very long texts are read whole; a
shingle that repeats counts as often; exactly half of the hashes leave a bit
unset; null ids take part under no id (a component of null ids only has a null
id); repeated rows give a row each; an empty table gives none; extra columns are
ignored, whatever their names. Ids are read as ``bigint``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, map_arrow, materialise, slices, text_bytes

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints that make one shard; of more, shards have about a quarter.
TREE_ROWS = 16_384
#: Fingerprints of a shard that one task takes; larger shards are cut.
SHARD_ROWS = 100_000
#: Rounds of cutting into rings, and a ring's width in radii.
ROUNDS, RING = 4, 2
#: Rows in a leaf of the tree, compared with all that ask in one vector operation.
LEAF = 64
#: Distances that a leaf works out at a time.
CELLS = 1 << 20

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of one UTF-8 text."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of ``hashes``."""
    n = len(hashes)
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 2000:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = [_signed(fingerprint(t, words, seed)) for t in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed bigint) of every row."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(source, _fingerprints(words, seed), "doc_id bigint, fp bigint")


def projections(rows: int, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> list[int]:
    """A bit mask for each family of shards: ``[0]`` (one shard) for up to
    ``tree_rows`` fingerprints, else the first bits of every ``m`` of
    ``radius + m`` bit groups."""
    if rows <= tree_rows:
        return [0]
    bits = max(1, math.ceil(math.log2(4 * rows / tree_rows)))
    m = next((m for m in range(1, 64 - radius) if m * (64 // (radius + m)) >= bits), 64 - radius)
    edges = [64 * i // (radius + m) for i in range(radius + m + 1)]
    parts = [sum(1 << b for b in range(lo, min(hi, lo + -(-bits // m)))) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, m)]


class Links:
    """A union-find over row numbers, for whole arrays."""

    def __init__(self, rows: int) -> None:
        self.parent = np.arange(rows)

    def find(self, rows: np.ndarray) -> np.ndarray:
        parent = self.parent
        roots = parent[rows]
        while True:
            above = parent[roots]
            if (above == roots).all():
                parent[rows] = roots
                return roots
            roots = parent[above]

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite ``a[i]`` with ``b[i]`` for all i; the smaller root stays."""
        a, b = self.find(a), self.find(b)
        while len(a):
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)
            a, b = self.find(low), self.find(high)


class VantagePointTree:
    """Hamming vantage-point tree over distinct fingerprints. A node is (first
    row, end row, vantage point, halves); a half is (least distance, greatest
    distance, node). Rows are kept in tree order."""

    def __init__(self, points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> None:
        self.radius, self.order, self.nodes = radius, np.arange(len(points)), 0
        self.points = points.copy()
        self.root = [0, len(points), None, ()]
        todo = [self.root]
        while todo:
            node = todo.pop()
            self.nodes += 1
            lo, hi = node[:2]
            if hi - lo <= leaf:
                continue
            far = np.bitwise_count(self.points[lo:hi] ^ self.points[lo])
            by = np.argsort(far, kind="stable")
            far = far[by]
            self.points[lo:hi], self.order[lo:hi] = self.points[lo:hi][by], self.order[lo:hi][by]
            cut = int(np.searchsorted(far, far[len(far) // 2]))  # the start of the median's distance
            if not cut:
                cut = int(np.searchsorted(far, far[0], side="right"))
            if cut == len(far):
                continue  # all lie at one distance
            node[2] = self.points[lo]
            node[3] = tuple((int(far[a]), int(far[b - 1]), [lo + a, lo + b, None, ()]) for a, b in ((0, cut), (cut, len(far))))
            todo += [half[2] for half in node[3]]

    def link(self, links: Links, asking: np.ndarray | None = None) -> None:
        """Unite all rows within the radius of each other; ``asking``: the
        positions (in tree order) that ask, all by default."""
        whole: set[int] = set()  # nodes known to be one component
        stack = [(self.root, np.arange(len(self.points)) if asking is None else asking)]
        while stack:
            node, ask = stack.pop()
            lo, hi, vantage, halves = node
            if not halves:
                ends = links.find(self.order[lo:hi])
                one = (ends == ends[0]).all()  # of one component: nothing to do for its own members
                if one:
                    ask = ask[links.find(self.order[ask]) != ends[0]]
                for at in range(0, len(ask), max(1, CELLS // (hi - lo))):
                    part = ask[at : at + max(1, CELLS // (hi - lo))]
                    near = np.bitwise_count(self.points[part, None] ^ self.points[None, lo:hi]) <= self.radius
                    i, j = np.nonzero(near.any(axis=1, keepdims=True) if one else near)
                    links.unite(self.order[part[i]], self.order[lo + j])
                continue
            d = np.bitwise_count(self.points[ask] ^ vantage).astype(np.int64)
            for least, greatest, half in halves:
                inside = d + greatest <= self.radius
                if inside.any():  # the ball holds the whole half
                    rows = self.order[half[0] : half[1]]
                    if id(half) not in whole:
                        links.unite(rows[1:], rows[:-1])
                        whole.add(id(half))
                    mine = self.order[ask[inside]]
                    links.unite(mine, np.full(len(mine), rows[0]))
                meets = ~inside & (d - self.radius <= greatest) & (d + self.radius >= least)
                if meets.any():
                    stack.append((half, ask[meets]))


def spanning_links(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(members, the smallest position of each member's component) of distinct
    ``points``, for the positions that are not the smallest themselves."""
    links = Links(len(points))
    VantagePointTree(points, radius).link(links)
    roots = links.find(np.arange(len(points)))
    members = np.flatnonzero(roots != np.arange(len(points)))
    return members, roots[members]


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may span batches."""
        rest: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(2)])
            rest.append(rows)
            if rest[0][0, 0] == rows[0, -1]:
                continue  # still the same shard
            rows = np.concatenate(rest, axis=1)
            last = rows[0] == rows[0, -1]
            rest = [rows[:, last]]
            yield _links(rows[:, ~last], radius)
        if rest:
            yield _links(np.concatenate(rest, axis=1), radius)

    return run


def _links(rows: np.ndarray, radius: int) -> pa.RecordBatch:
    starts = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
    out = [np.zeros((2, 0), np.int64)]
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.shape[1]]):
        if end - start > 1:
            part = np.unique(rows[1, start:end])
            members, roots = spanning_links(part.view(np.uint64), radius)
            out.append(np.stack([part[members], part[roots]]))
    found = np.concatenate(out, axis=1)
    return pa.record_batch([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])


def shards_of(prints: DataFrame, rows: int, radius: int = RADIUS, tree_rows: int = TREE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, fp): the ``rows`` distinct fingerprints of ``prints`` dealt into
    overlapping shards of at most about ``shard_rows`` fingerprints. Shard names
    are hashes; two shards of one name are compared together, which does no harm."""
    masks = projections(rows, radius, tree_rows)
    balls = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    shards = prints.select(F.explode(F.array(*balls)).alias("shard"), "fp")
    for turn in range(ROUNDS + 1):
        if len(masks) == 1 and rows <= shard_rows:
            return shards
        # the vantage point is the least fingerprint under a hash of the round
        sizes = shards.groupBy("shard").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(turn))).alias("v"))
        large = materialise(sizes.where(F.col("n") > shard_rows), "large_shards")
        if large.isEmpty():
            return shards
        told = join_groups(shards, large.withColumn("rows", F.col("n")), "shard", "n", "fp")
        if turn < ROUNDS:
            width = RING * radius
            far = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
            ring = F.floor(far / width)
            names = [F.xxhash64("shard", F.lit(turn), r) for r in (ring, ring + 1)]
            rings = F.when(far % width >= width - radius, F.array(*names)).otherwise(F.array(names[0]))
        else:
            n = F.ceil(2 * F.col("rows") / shard_rows).cast("bigint")
            own = F.pmod(F.xxhash64(F.lit("block"), "fp"), n)
            pair = lambda j: F.xxhash64("shard", F.lit(turn), F.least(own, j), F.greatest(own, j))
            rings = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), pair)
        kept = F.when(F.col("rows").isNull(), F.array("shard")).otherwise(rings)
        shards = materialise(told.select(F.explode(kept).alias("shard"), "fp"), "shards")
    return shards


def near_links(prints: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints of column ``fp``."""
    shards = shards_of(prints, prints.count(), radius, tree_rows, shard_rows)
    return map_arrow(shards.repartition("shard").sortWithinPartitions("shard"), _shard_links(radius), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(a, root) for every vertex that has a link, root being the smallest of
    its component: alternating large and small stars, a checkpoint each round,
    until a round changes no edge."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = join_groups(both.where("b > a"), least, "a", "n", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large_star")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = join_groups(large, least, "a", "n", "b").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("e"))
        now = materialise(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "small_star")
        # both hold an edge once: as many edges and none new means the same edges
        if now.count() == edges.count() and now.join(edges, ["a", "b"], "left_anti").isEmpty():
            return now.select("a", F.col("b").alias("root"))
        edges = now


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``."""
    rows = materialise(fingerprints(docs, words, seed), "fingerprints")
    owners = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint_owners")
    roots = components(near_links(owners.select("fp"), radius))
    linked = owners.join(roots, F.col("fp") == F.col("a"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    of = join_groups(linked, materialise(ids, "component_ids"), "root", "members", "fp").select("fp", "n", "component_id")
    out = join_groups(rows, materialise(of, "fingerprint_components"), "fp", "n", "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the document of the smallest id of each near-duplicate
    group only; columns stay as they are. Rows without an id all stay; rows that
    repeat an id and text count once, and rows of one id with different texts
    stay or go together."""
    found = materialise(near_duplicates(docs, **how), "near_duplicates")
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    again = materialise(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated_ids")
    if again.isEmpty():
        return kept
    single = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
