"""Join operators: anti and semi joins, defaults, intervals, as-of, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query side that is small by construction.
QUERY_ROWS = 1000


def without(rows: DataFrame, known: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key isn't in ``known`` (pending work, deletions, orphans)."""
    return rows.join(known, key, "left_anti")


def interval_overlaps(left: DataFrame, right: DataFrame, keys: list[str], l_start: str, l_end: str, r_start: str, r_end: str, width: float) -> DataFrame:
    """Pairs of intervals that overlap inside equal ``keys``. Both sides are dealt
    into cells of ``width`` so that the join is an equi-join; a pair is reported in
    the first cell that both touch."""

    def cells(start: str, end: str) -> Column:
        return F.sequence(F.floor(F.col(start) / width).cast("bigint"), F.floor(F.col(end) / width).cast("bigint"))

    a = left.withColumn("_cell", F.explode(cells(l_start, l_end)))
    b = right.withColumn("_cell", F.explode(cells(r_start, r_end)))
    first = F.floor(F.greatest(F.col(l_start), F.col(r_start)) / width).cast("bigint")
    joined = a.join(b, [*keys, "_cell"]).where((F.col(l_start) < F.col(r_end)) & (F.col(l_end) > F.col(r_start)))
    return joined.where(F.col("_cell") == first).drop("_cell")


def as_of_previous(rows: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """The last non-null ``value`` of the rows before, in its series."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], l_time: str, r_time: str, values: list[str]) -> DataFrame:
    """For each left row the latest right row at or before its time: one union
    and one ordered window, no range comparison of pairs."""
    r = right.select(*keys, F.col(r_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    carried = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(l_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*carried).alias("_l"))
    both = a.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*keys, "_l.*", "_v.*")


def single_match(rows: DataFrame, candidates: DataFrame, key: str, score: Column, least: float) -> DataFrame:
    """Rows with exactly one candidate whose score reaches ``least``."""
    good = rows.join(candidates, key).where(score >= least)
    return good.withColumn("_n", F.count("*").over(Window.partitionBy(*rows.columns))).where("_n = 1").drop("_n")
