"""Importance resampling towards a target distribution, without exploding texts.

A document's features (runs of 1 to 3 words) become one array of buckets through
higher-order functions: words are zipped with their neighbours to pairs and
triples, each hashed by crc32 modulo ``BUCKETS``. The arrays are written once.
Tasks add their arrays up to at most ``BUCKETS`` totals each, and only these are
shuffled. The gains of all buckets are one literal array; a document's weight is
an ``aggregate`` over its buckets with ``element_at`` of that array, so scoring
neither explodes nor joins.

The draw is by Gumbel keys: the highest weight plus noise by a hash of the id.
Ranks are places in a range-partitioned order of narrow rows: a place within the
partition plus the sizes of the partitions before it. No task orders all rows, and
rows of equal score and id are dealt by their place in the written table.

Defined results: a null text has no words, and so has an empty one; weight 0,
never drawn (under ``LEAST_WORDS`` words); texts of any length are read whole, as
one row's array; bytes that are not UTF-8 count as U+FFFD; a null id is hashed as
'' and comes first among ties; repeated rows count and are drawn one by one; an
empty benchmark leaves t = T = 0; an empty table gives no rows; other columns are
ignored, whatever their names. Ids are read as bigint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

BUCKETS = 10_000
LONGEST = 3
SEED = 42
LEAST_WORDS, PERCENT = 20, 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all ASCII but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _from(items: Column, first: int, fewer: int) -> Column:
    """``items`` from place ``first`` (1-based), less so many at the ends in all."""
    return F.slice(items, F.lit(first), F.greatest(F.size(items) - fewer, F.lit(0)))


def run_buckets(items: Column, longest: int = LONGEST) -> list[Column]:
    """Arrays of the buckets of the runs of 1, 2, ... ``longest`` consecutive words.
    Strings of runs are made where a longer run needs them; the last are only hashed."""
    bucket = lambda x: (F.crc32(x.cast("binary")) % BUCKETS).cast("int")
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    run, found = items, [F.transform(items, bucket)]
    for n in range(2, longest + 1):
        shorter, words_behind = _from(run, 1, 1), _from(items, n, n - 1)
        if n == longest:
            found.append(F.zip_with(shorter, words_behind, lambda a, b: bucket(joined(a, b))))
        else:
            run = F.zip_with(shorter, words_behind, joined)
            found.append(F.transform(run, bucket))
    return found


def bucketed(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """``kept`` with n_words and buckets, an int a feature."""
    rows = docs.select(*kept, words(F.col("text").cast("string")).alias("words"))
    return rows.select(*[c for c in rows.columns if c != "words"], F.size("words").alias("n_words"), F.concat(*run_buckets(F.col("words"))).alias("buckets"))


def totals(rows: DataFrame) -> list[int]:
    """Features of each bucket over all ``rows``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=BUCKETS)
        some = np.flatnonzero(held)
        yield pa.record_batch({"bucket": pa.array(some.astype(np.int32)), "n": pa.array(held[some])})

    summed = map_arrow(rows.select("buckets"), add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = [0] * BUCKETS
    for bucket, n in summed.collect():  # BUCKETS rows at most
        found[bucket] = n
    return found


def gains(spark, source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of (smoothed target share / smoothed source share)) a bucket."""
    rows = spark.createDataFrame(list(zip(range(BUCKETS), source, target)), "bucket int, s bigint, t bigint")
    of_source, of_target = F.lit(float(sum(source) + BUCKETS)), F.lit(float(sum(target) + BUCKETS))
    ratio = ((F.col("t").cast("double") + 1.0) * of_source) / ((F.col("s").cast("double") + 1.0) * of_target)
    return [r[0] for r in rows.orderBy("bucket").select(F.floor(F.lit(1000.0) * F.log(ratio))).collect()]


def scored(rows: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of bucketed rows."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    weight = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda sum_, b: sum_ + F.element_at(literal, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    out = rows.select("doc_id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), weight.alias("weight"), noise.alias("noise"))
    return out.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def draw(rows: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (a written table) with ``rank``: 1, 2, ... for the ``percent`` of
    the rows of ``least`` words or more with the highest scores, null for others."""
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    able = rows.where(F.col("n_words") >= least)
    ordered = able.repartitionByRange(F.desc("score"), F.asc("doc_id"), F.asc("place")).sortWithinPartitions(F.desc("score"), F.asc("doc_id"), F.asc("place"))
    ordered = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "importance_order")
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in ordered.groupBy(part.alias("part")).count().collect())  # a row a partition
    before, starts = 0, []
    for i, n in sizes:
        starts.append((i, before))
        before += n
    drawn = percent * before // 100
    offsets = rows.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= drawn, rank))
    others = rows.where((F.col("n_words") < least) | F.col("n_words").isNull()).withColumn("rank", F.lit(None).cast("bigint"))
    columns = [c for c in rows.columns if c != "place"] + ["rank"]
    return ranked.select(*columns).unionByName(others.select(*columns))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    rows = materialise(bucketed(docs, [F.col("doc_id").cast("bigint").alias("doc_id")]), "importance_buckets")
    gain = gains(docs.sparkSession, totals(rows), totals(bucketed(target, [])))
    drawn = draw(materialise(scored(rows, gain, seed), "importance_scores"), percent)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
