"""Language-model scores by prediction by partial matching over bytes.

The model is a byte-context trie of order ``ORDER``, kept as one table of
(context, symbol) counts for each order. Every training byte is counted. The
longest order holds occurrences; a shorter one counts the distinct longer
contexts a symbol was seen in (update exclusion). A symbol that its context has
not seen escapes (method D: half a count for each distinct symbol) to the next
shorter context, without the symbols already ruled out (symbol exclusion); below
order 0 every byte left is equally likely. A text's score is the sum of the
log10 probabilities of its bytes and of an end symbol.

Because a context's symbols are a subset of its suffix's, what exclusion leaves
of the suffix depends on the context alone, so it is worked out once per
context and scoring is a table look-up per byte, whole batches at a time.

Counts are gathered by one aggregation over the corpus, and no entry is left
out. The ``HEAD_GRAMS`` most frequent entries of the longest order go to the
tasks with their probabilities, which spares most bytes a shuffle. All other
bytes are dealt, with the whole table, by the last ``BASE`` + 1 bytes of their
context: every longer context of a byte is then in its partition, which works
out the longer orders from its share of the table; the shorter orders, whose
size the alphabet bounds, are broadcast whole. The word base score sends the
``HEAD_WORDS`` most frequent words (of at most ``HEAD_BYTES`` bytes each) to the
tasks; the counts of all others are joined, exactly, from the aggregated table.

Defined results: null text counts as empty (its only token is the end); very long
texts are read whole, in parts that know what precedes; a null id counts as ''
for the fold; with no training rows N and V are 0 and each byte has probability
1/256; entries of equal count are all at hand or all looked up, which changes no
score; repeated rows count and score one by one; an empty table gives no rows;
extra columns are ignored, whatever their names; ids keep their type.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, join_groups, map_arrow, materialise, slices, text_bytes

ORDER = 5
#: The longest of the orders that are broadcast whole.
BASE = 2
HEAD_GRAMS = 1_250_000
#: Grams of the longest order in a partition of the table, about.
BLOCK_GRAMS = 100_000
#: Grams asked under one context that a task answers, about.
BLOCK_ASKED = 1_000_000
HEAD_WORDS = 200_000
HEAD_BYTES = 64
FOLDS = 7
HELD_OUT = 2
DISCOUNT = 0.5
SYMBOLS = 256
#: Bytes that UTF-8 never holds.
END, START = 0xFF, 0xFE
#: Distinct grams that a training task holds before it hands them on.
TASK_GRAMS = 4_000_000
TASK_WORDS = 500_000
#: Text bytes that are turned into keys at a time.
UNIT_BYTES = 2 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def units(texts: list[bytes], order: int, most: int = UNIT_BYTES) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Groups of (row, context, bytes to predict) of about ``most`` bytes: each
    text with its end symbol, a very long one in parts that know what precedes."""
    group, held, pad = [], 0, bytes([START]) * order
    for row, text in enumerate(texts):
        text += bytes([END])
        for at in range(0, len(text), most):
            group.append((row, text[at - order : at] if at else pad, text[at : at + most]))
            held += len(group[-1][2])
            if held >= most:
                yield group
                group, held = [], 0
    if group:
        yield group


def gram_keys(group: list[tuple[int, bytes, bytes]], order: int) -> np.ndarray:
    """A key for each byte to predict: ``order`` bytes of context above it."""
    joined = np.frombuffer(b"".join(part for _, context, body in group for part in (context, body)), np.uint8)
    keys = np.zeros(len(joined) - order, np.uint64)
    for j in range(order + 1):
        keys |= joined[j : len(joined) - order + j].astype(np.uint64) << np.uint64(8 * (order - j))
    # between two units stand ``order`` windows that predict the next context
    keep = np.ones(len(keys), bool)
    ends = np.cumsum([len(body) + order for _, _, body in group])[:-1] - order
    keep[(ends[:, None] + np.arange(order)).ravel()] = False
    return keys[keep]


class Table:
    """uint64 keys to row numbers: buckets by the top bits of a product."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(1, int(1.5 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        bucket = self._bucket(keys)
        self.order = np.argsort(bucket, kind="stable").astype(np.int32)
        self.start = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(bucket.astype(np.int64), minlength=1 << bits), out=self.start[1:])
        self.keys = np.r_[keys[self.order], np.uint64(0)]
        self.longest = int(np.diff(self.start).max()) if len(keys) else 0

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions in ``self.keys``, -1 where absent."""
        bucket = self._bucket(keys).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        hit = (self.keys[at] == keys) & (at < end)
        if hit.all():
            return at
        out = np.where(hit, at, np.int32(-1))
        left = np.flatnonzero(~hit & (end - at > 1))
        for step in range(1, self.longest):
            if not len(left):
                break
            left_at = at[left] + np.int32(step)
            found = self.keys[left_at] == keys[left]
            out[left[found]] = left_at[found]
            left = left[~found & (end[left] - left_at > 1)]
        return out


def levels_of(keys: np.ndarray, counts: np.ndarray, order: int, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, counts, context totals) of the orders ``least`` to ``order``,
    shortest first, from the grams of the longest."""
    levels = []
    for k in range(order, least - 1, -1):
        _, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        levels.append((keys, counts, np.bincount(of, counts)[of]))
        keys, counts = np.unique(keys & np.uint64((1 << 8 * k) - 1), return_counts=True)
    return levels[::-1]


class Model:
    """Tables by order: ``levels[k]`` = (keys, counts, totals) of (context of k
    bytes, symbol), totals being the whole count of the context, entries that
    are not given included; their share is added to the context's escape. With
    ``base`` the levels continue those of that model."""

    def __init__(self, levels: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], base: Model | None = None) -> None:
        parts = ("grams", "weight", "contexts", "facts")
        self.grams, self.weight, self.contexts, self.facts = ([*getattr(base, p)] if base else [] for p in parts)
        self.counts = base.counts if base else None
        for k, (keys, counts, totals) in enumerate(levels, len(self.grams)):
            table = Table(keys)
            contexts, first, of = np.unique(keys >> np.uint64(8), return_index=True, return_inverse=True)
            n = totals[first].astype(float)
            d = np.bincount(of, minlength=len(contexts)).astype(float)
            escape = DISCOUNT * d + n - np.bincount(of, counts, len(contexts))
            if k:  # what stays of the suffix once this context's symbols are ruled out
                parent = self.contexts[-1].find(contexts & np.uint64((1 << 8 * (k - 1)) - 1))
                suffix = self.grams[-1].find(keys & np.uint64((1 << 8 * k) - 1))
                n_left = self.facts[-1][0][parent] - np.bincount(of, self.counts[suffix], len(contexts))
                e_left = self.facts[-1][1][parent] - DISCOUNT * d
            else:
                n_left, e_left = SYMBOLS - d, np.zeros(len(contexts))
            place = Table(contexts)
            self.grams.append(table)
            self.weight.append(np.log10(counts - DISCOUNT)[table.order].astype(np.float32))
            self.contexts.append(place)
            # one more, for the position -1 of what is absent
            self.facts.append([np.r_[x[place.order], 0.0] for x in (n, escape, n_left, e_left)])
            self.counts = counts[table.order].astype(float)
            del table.order, place.order, keys, counts, totals, contexts, first, of
        self.order = len(self.grams) - 1
        # at the longest order, the whole probability at once
        place = self.contexts[-1].find(self.grams[-1].keys[:-1] >> np.uint64(8))
        self.direct = (self.weight[-1] - np.log10(self.facts[-1][0][place])).astype(np.float32)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram key (of the longest order)."""
        if len(self.grams[0].keys) == 1:
            return np.full(len(keys), -np.log10(SYMBOLS))
        out = np.zeros(len(keys))
        at = self.grams[-1].find(keys)
        hit = at >= 0
        out[hit] = self.direct[at[hit]]
        left = np.flatnonzero(~hit)
        n, e = np.full(len(left), -1.0), np.zeros(len(left))  # -1: no context met yet
        for k in range(self.order, -1, -1):
            own = keys[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            place = self.contexts[k].find(own >> np.uint64(8))
            met = place >= 0
            total, escape, n_left, e_left = (np.where(met, x[place], 0.0) for x in self.facts[k])
            first = met & (n < 0)
            n[first], e[first] = total[first], escape[first]
            asked = met & (n > 1e-9) & (e > 1e-9)
            at = np.full(len(left), -1, np.int32)
            at[asked] = self.grams[k].find(own[asked])
            found = at >= 0
            out[left[found]] += self.weight[k][at[found]] - np.log10(n[found])
            missed = asked & ~found
            out[left[missed]] += np.log10(np.minimum(e[missed] / n[missed], 1))
            n, e = np.where(met, n_left, n)[~found], np.where(met, e_left, e)[~found]
            left = left[~found]
            if not len(left):
                return out
        out[left] -= np.log10(np.maximum(n, 1))  # the bytes that no context has shown
        return out


class Head:
    """Frequent grams of the longest order and their log10 probabilities."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, order: int) -> None:
        self.grams, self.order = Table(keys), order
        self.direct = np.r_[(np.log10(counts - DISCOUNT) - np.log10(totals))[self.grams.order], 0.0].astype(np.float32)
        del self.grams.order

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sum of each text over the bytes known here, the keys of all other
        bytes, and where those of each text begin and end."""
        out, missed, rows = np.zeros(len(texts)), [np.zeros(0, np.uint64)], np.zeros(len(texts) + 1, np.int64)
        for group in units(texts, self.order):
            keys = gram_keys(group, self.order)
            at = self.grams.find(keys)
            starts = np.r_[0, np.cumsum([len(body) for _, _, body in group])[:-1]]
            row = [r for r, _, _ in group]
            np.add.at(out, row, np.add.reduceat(self.direct[at].astype(float), starts))
            np.add.at(rows, np.array(row) + 1, np.add.reduceat((at < 0).astype(np.int64), starts))
            missed.append(keys[at < 0])
        return out, np.concatenate(missed), np.cumsum(rows)


def _counted(order: int):
    """Map side of the counting: (gram, null, n) and (null, word, n) rows; gram
    -1 counts the training rows."""

    def batch(grams: np.ndarray, words: list[bytes], counts) -> pa.RecordBatch:
        return pa.record_batch(
            [
                pa.concat_arrays([pa.array(grams.view(np.int64)), pa.nulls(len(words), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(grams), pa.binary()), pa.array(words, pa.binary())]),
                pa.array(counts, pa.int64()),
            ],
            names=["gram", "word", "n"],
        )

    def out(grams: np.ndarray, words: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(counts), 100_000):
            to = at + 100_000
            yield batch(grams[at:to], words[at:to], counts[at:to])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, counts, rows, none = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, np.zeros(0, np.uint64)
        for piece in slices(batches, "text"):
            texts = text_bytes(piece.column(0))
            rows += len(texts)
            for text in texts:
                words.update(text.lower().split())
            parts = [np.unique(gram_keys(g, order), return_counts=True) for g in units(texts, order)]
            keys, counts = _merged([(keys, counts), *parts])
            if len(keys) > TASK_GRAMS:
                yield from out(keys, [], counts)
                keys, counts = none, np.zeros(0, np.int64)
            if len(words) > TASK_WORDS:
                yield from out(none, list(words), np.array(list(words.values()), np.int64))
                words.clear()
        yield from out(keys, [], counts)
        yield from out(none, list(words), np.array(list(words.values()), np.int64))
        yield batch(np.array([-1], np.int64).view(np.uint64), [], np.array([rows], np.int64))

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(of, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def corpus_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, word, n) over all rows of the column ``text``; see ``_counted``."""
    rows = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialise(map_arrow(rows, _counted(order), "gram bigint, word binary, n bigint").groupBy("gram", "word").agg(F.sum("n").alias("n")), "lm_counts")


def _least_count(table: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` rows have it or more, from
    a histogram over eighths of powers of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    left = most
    for bucket, rows in sorted(table.groupBy(step.alias("b")).count().collect(), reverse=True):
        left -= rows
        if left < 0:
            return int(np.floor(2 ** ((bucket + 1) / 8))) + 1
    return 1


def _fetched(rows: DataFrame) -> list[np.ndarray]:
    """The columns of ``rows``, by the first one, a gram key."""
    found = rows.toArrow()
    keys = found.column(0).to_numpy().astype(np.uint64)
    by = np.argsort(keys)
    return [keys[by], *(c.to_numpy()[by] for c in found.columns[1:])]


def head_of(grams: DataFrame, order: int, most: int) -> Head:
    """The ``most`` most frequent grams, or fewer where counts are equal."""
    context = F.shiftright("gram", 8)
    kept = grams.where(F.col("n") >= _least_count(grams, most))
    totals = grams.groupBy(context.alias("c")).agg(F.sum("n").alias("total"))
    return Head(*_fetched(kept.join(totals, context == F.col("c")).select("gram", "n", "total")), order)


def base_of(grams: DataFrame, order: int) -> Model | None:
    """The whole model of the orders up to ``BASE`` (below ``order``)."""
    base = min(BASE, order - 1)
    if base < 0:
        return None
    longer = grams.select(F.col("gram").bitwiseAND(F.lit((1 << 8 * (base + 2)) - 1)).alias("gram")).distinct()
    rows = longer.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (base + 1)) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    return Model(levels_of(*_fetched(rows), base, 0))


def _answered(base, order: int):
    """Rows (gram, -count), which make the model, then (gram, row) by row, to
    (row, sum of log10 probabilities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, machine = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], None
        for batch in batches:
            grams, what = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()
            n = int(np.searchsorted(what, 0))
            keys.append(grams[:n])
            counts.append(-what[:n])
            if n == len(what):
                continue
            if machine is None:
                keys, counts = np.concatenate(keys), np.concatenate(counts)
                keys, by = np.unique(keys, return_index=True)  # two copies may meet
                least = 0 if base is None else base.value.order + 1
                machine = Model(levels_of(keys, counts[by], order, least), base and base.value)
                keys, counts = [], []
            rows, first = np.unique(what[n:], return_index=True)
            sums = np.add.reduceat(machine.log10(grams[n:]), first)
            yield pa.record_batch([pa.array(rows), pa.array(sums)], names=["row", "more_score"])

    return run


def answers(asked: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """(row, more_score): for the rows (row, gram) asked, their sums of log10
    probabilities under the whole table ``grams``, in parts."""
    model = base_of(grams, order)
    base = None if model is None else grams.sparkSession.sparkContext.broadcast(model)
    blocks = max(1, -(-grams.count() // BLOCK_GRAMS))
    # rows asked under a frequent context are dealt to several tasks, each with a copy
    # of the context's part of the table
    block = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * (min(BASE, order - 1) + 1)) - 1)).alias("block")
    asked, table = asked.select("row", "gram", block), grams.select("gram", "n", block)
    sizes = asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ASKED).cast("int").alias("shares")).where("shares > 1")
    hot = F.broadcast(materialise(sizes, "lm_hot_contexts"))  # one row for BLOCK_ASKED of those asked at most
    share = F.pmod(F.xxhash64("row", "gram"), F.coalesce("shares", F.lit(1))).cast("int").alias("share")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share")
    told = table.join(hot, "block", "left").select("gram", (-F.col("n")).alias("what"), "block", copies)
    both = told.union(asked.join(hot, "block", "left").select("gram", F.col("row").alias("what"), "block", share))
    dealt = both.repartition(blocks, "block", "share").sortWithinPartitions("what").select("gram", "what")
    return map_arrow(dealt, _answered(base, order), "row bigint, more_score double")


def _scored(model, head, ends: int):
    """One pass: the part of both scores that the head grams and words give, and what they lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        known, machine = head.value, model.value
        for batch in slices(batches, "text"):
            texts = text_bytes(batch.column(2))
            tokens, seen, sums, words, counts, offsets = [], [], [], [], [], [0]
            for text in texts:
                parts = text.lower().split()
                tally = Counter(parts)
                n = list(tally.values())
                c = np.fromiter(map(known.get, tally, repeat(0)), np.int64, len(tally))
                n_head = np.array(n, np.int64)
                tokens.append(len(parts) + 1)
                seen.append(int(n_head[c > 0].sum()) + (ends > 0))
                sums.append(float((n_head * np.log10(c + 1)).sum() + np.log10(ends + 1)))
                rest = [(w, m) for (w, m), at in zip(tally.items(), c.tolist()) if not at]
                words += [w for w, _ in rest]
                counts += [m for _, m in rest]
                offsets.append(len(words))
            tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"]))
            scores, missed, starts = machine.scores(texts)
            grams = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(missed.view(np.int64)))
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.record_batch(
                [pa.array(rows, pa.int64()), batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array(sums), pa.array(scores), tail, grams],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "tail", "grams"],
            )

    return run


def score(docs: DataFrame, order: int = ORDER, head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    held_out = crc_mod("doc_id", FOLDS) == HELD_OUT
    counts = corpus_counts(docs.where(~held_out), order)
    words = counts.where("word is not null").select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where("gram = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = total + ends, distinct + (ends > 0)
    grams = counts.where("gram >= 0").select("gram", "n")
    model = spark.sparkContext.broadcast(head_of(grams, order, head_grams))
    short = words.where(F.octet_length("word") <= HEAD_BYTES)
    least = _least_count(short, head_words)
    in_head = (F.octet_length("word") <= HEAD_BYTES) & (F.col("n") >= least)
    top = words.where(in_head).toArrow()
    head = spark.sparkContext.broadcast(dict(zip(text_bytes(top.column(0)), top.column(1).to_pylist())))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, score double, tail array<struct<word: binary, n: bigint>>, grams array<bigint>"
    found = materialise(map_arrow(rows, _scored(model, head, ends), schema), "lm_scored")
    tail = found.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.n").alias("times"))
    rare = words.where(~in_head)
    met = join_groups(tail, rare.select("word", "n", F.col("n").alias("size")), "word", "size", "row").where("n is not null")
    from_words = met.select("row", F.col("times").alias("more"), (F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.lit(0.0).alias("more_score"))
    asked = found.select("row", F.explode("grams").alias("gram"))
    from_grams = answers(asked, grams, order).select("row", F.lit(0).cast("bigint").alias("more"), F.lit(0.0).alias("more_logs"), "more_score")
    more = from_words.union(from_grams).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "more_logs", "more_score")])
    log_all = float(np.log10(total + distinct + 1))
    return found.drop("tail", "grams").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
