"""Filter interaction audit over a packed bitmap index.

A row of the index is a document: a bit for each filter that it fails and for
each label that it carries. Each task packs its rows into NumPy bitsets, part by
part (every part begins a new 64-bit word), and answers each (prefix set, next
filter) with AND, AND-NOT and a population count over the words: what the filter
removes after the filters of the prefix is ``fails & ~(OR of the prefix)``. The
order inside a prefix does not matter, so m filters need m * 2^(m-1) counts
instead of m * m!. Tasks emit counts only; these are summed by (part, prefix,
filter), and a table of all orders reads its steps from the sums.

``corpus_index`` makes the index of the five corpus filters: one Arrow pass over
the whole texts gives A to D and a digest of the text. E ("a smaller id has the
same text") needs no group of copies in one task: the smallest id of each text is
an aggregate that combines before the shuffle, and a row fails E if its (id,
digest) is not among those, a join on the id. Labels are joined on the id too.

Defined results: a null text is empty: no words, no code points (A fails, B, C and
D hold); texts of any length are read whole; a null part is ''; a null id has no
smaller id and is no smaller id, so it holds E, and has no labels; rows of one id
and text do not fail E against each other; a label is set if any of the id's label
rows sets it; an empty table has no parts and gives no rows; extra columns are
ignored, whatever their names. Ids are read as bigint.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, slices, text_bytes

FILTERS = "ABCDE"
LABELS = ("good", "toxic")
#: A: fewer words fail. B: distinct words, percent of words. C: capitals, percent of code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Rows of which a task holds bits at a time.
INDEX_ROWS = 1 << 20

_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def text_failures(text: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = text.split()  # at \x20 and \x09-\x0d
    n, size = len(words), len(text)
    capitals = size - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _FOLLOWING))
    marked = len(text.translate(None, _MARKS)) < size
    return (n < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | marked << 3


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = text_bytes(batch.column(1))
        fails = pa.array([text_failures(t) for t in texts], pa.int32())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.record_batch({"id": batch.column(0), "part": batch.column(2), "fails": fails, "digest": digests})


def corpus_index(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (a bit a filter), labels (a bit a label) of every document."""
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"), part)
    rows = materialise(map_arrow(slim, _read, "id bigint, part string, fails int, digest binary"), "audit_rows")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    bit = lambda c, i: F.max(F.when(F.col(c) == 1, 1 << i).otherwise(0))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg((bit("quality", 0) + bit("toxic", 1)).alias("labels"))
    rows = rows.join(first, (F.col("id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left").join(told, F.col("id") == F.col("label_id"), "left")
    copy = F.when(F.col("id").isNotNull() & F.col("first_id").isNull(), 16).otherwise(0)
    return rows.select("part", F.col("fails").bitwiseOR(copy).alias("fails"), F.coalesce("labels", F.lit(0)).alias("labels"))


class Bitmaps:
    """Bitsets of filters and labels over rows that are grouped by part; each part
    begins a word. Rows of padding are in no bitset."""

    def __init__(self, parts: np.ndarray, n_parts: int, fails: np.ndarray, labels: np.ndarray, n_filters: int, n_labels: int) -> None:
        order = np.argsort(parts, kind="stable")
        sizes = np.bincount(parts, minlength=n_parts)
        words = (sizes + 63) // 64
        self.starts = np.concatenate([[0], np.cumsum(words)[:-1]])
        place = np.arange(len(parts)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts * 64, sizes)
        self.n_words = int(words.sum())

        def packed(bits: np.ndarray) -> np.ndarray:
            spread = np.zeros(self.n_words * 64, dtype=bool)
            spread[place] = bits[order]
            return np.packbits(spread).view(np.uint64)

        self.rows = packed(np.ones(len(parts), dtype=bool))
        self.fails = [packed(fails >> i & 1 != 0) for i in range(n_filters)]
        self.labels = [packed(labels >> i & 1 != 0) for i in range(n_labels)]

    def count(self, bits: np.ndarray) -> np.ndarray:
        """Set bits of each part."""
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.starts)

    def any_of(self, filters: int) -> np.ndarray:
        """Rows that fail one of a set of filters."""
        found = np.zeros(self.n_words, dtype=np.uint64)
        for i, bits in enumerate(self.fails):
            if filters >> i & 1:
                found = found | bits
        return found

    def steps(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(prefix set, filter, counts of each part): kept, removed, redundant,
        unique_fails, then what is lost of each label."""
        m = len(self.fails)
        gone = [self.any_of(s) for s in range(1 << m)]
        for f, fails in enumerate(self.fails):
            unique = self.count(fails & ~gone[(1 << m) - 1 & ~(1 << f)])
            for prefix in range(1 << m):
                if prefix >> f & 1:
                    continue
                removed = fails & ~gone[prefix]
                kept = self.rows & ~gone[prefix | 1 << f]
                yield prefix, f, [self.count(kept), self.count(removed), self.count(fails & gone[prefix]), unique, *[self.count(removed & lost) for lost in self.labels]]


def prefix_counts(index: DataFrame, n_filters: int, label_names: Sequence[str]) -> DataFrame:
    """part, prefix (set of filters), filter, and the counts: at the filter when
    those of the prefix have run. ``index``: part, fails, labels."""
    names = ["kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in label_names]]

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        part = rows.column("part").combine_chunks().dictionary_encode()
        bits = [rows.column(c).to_numpy() for c in ("fails", "labels")]
        maps = Bitmaps(part.indices.to_numpy(), len(part.dictionary), *bits, n_filters, len(label_names))
        n = len(part.dictionary)
        for prefix, f, counts in maps.steps():
            yield pa.record_batch({"part": part.dictionary, "prefix": pa.array(np.full(n, prefix, np.int32)), "filter": pa.array(np.full(n, f, np.int32))} | {c: pa.array(x) for c, x in zip(names, counts)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= INDEX_ROWS:
                yield from counted(held)
                held, rows = [], 0
        if held:
            yield from counted(held)

    slim = index.select("part", F.col("fails").cast("int").alias("fails"), F.col("labels").cast("int").alias("labels"))
    schema = "part string, prefix int, filter int, " + ", ".join(f"{c} bigint" for c in names)
    return map_arrow(slim, run, schema).groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in names])


def audit(index: DataFrame, filters: str = FILTERS, label_names: Sequence[str] = LABELS) -> DataFrame:
    """A row a part, order of all filters and step: the step's counts, and its
    filter's removals summed over all orders (``shapley``)."""
    m = len(filters)
    spark = index.sparkSession
    counts = materialise(prefix_counts(index, m, label_names), "audit_counts")
    # a prefix of p filters comes before the filter in p! (m - 1 - p)! orders
    weights = F.array(*[F.lit(math.factorial(p) * math.factorial(m - 1 - p)) for p in range(m)])
    shapley = F.sum(F.col("removed") * F.element_at(weights, F.bit_count("prefix") + 1)).alias("shapley")
    shares = counts.groupBy("part", "filter").agg(shapley)
    steps = [("".join(filters[i] for i in order), at + 1, sum(1 << i for i in order[:at]), f) for order in itertools.permutations(range(m)) for at, f in enumerate(order)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, prefix int, filter int")
    told = counts.join(shares, ["part", "filter"]).join(F.broadcast(orders), ["prefix", "filter"])
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in label_names], "shapley")


def corpus_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(corpus_index(docs, labels))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), x AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(w) < {LEAST_WORDS},
    100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)
), n AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM x GROUP BY ALL
), f AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, f.i AS step, o[f.i] AS filter, n, good, toxic,
         fails[o[f.i]] AS fails, list_bool_or(list_transform(o[1:f.i - 1], lambda i: fails[i])) IS TRUE AS gone,
         list_bool_or(list_transform(list_filter([1, 2, 3, 4, 5], lambda i: i <> o[f.i]), lambda i: fails[i])) AS other
  FROM n, o, f
), t AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
         coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (fails AND NOT other), 0) AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM t
"""
