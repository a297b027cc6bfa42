"""Aggregation operators: facets, digests, histograms, buckets, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Count by non-empty value; an array counts each of its elements."""
    return rows.select(value.alias(name)).where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.count("*").alias("n"))


def digest(rows: DataFrame, key: str, item: Column, most: int) -> DataFrame:
    """Rows of each ``key``, and its first ``most`` items in their order. The
    items are ranked before they are gathered, so no group gathers more."""
    ranked = rows.select(key, item.alias("_item")).withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy("_item")))
    kept = F.collect_list(F.when(F.col("_place") <= most, F.col("_item")))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(kept).alias("items"))


def share(rows: DataFrame, key: str, amount: str, decimals: int = 4) -> DataFrame:
    """Total and share of the grand total by key."""
    sums = rows.groupBy(key).agg(F.sum(amount).alias("total"))
    whole = sums.agg(F.sum("total").alias("_all"))  # one row
    return sums.join(F.broadcast(whole)).select(key, F.round("total", 2).alias("total"), F.round(F.col("total") / F.col("_all"), decimals).alias("share"))


def repeated_values(rows: DataFrame, group: str, unit: str, value: str, least: int = 3, part: float = 0.5) -> DataFrame:
    """Values on at least max(``least``, ceil(n * ``part``)) units of their group."""
    units = rows.groupBy(group).agg(F.count_distinct(unit).alias("_units"))
    seen = rows.select(group, unit, value).distinct().groupBy(group, value).agg(F.count("*").alias("n"))
    return seen.join(units, group).where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("_units") * part))).drop("_units")


def due_bucket(days_left: Column) -> Column:
    return F.when(days_left < 0, "overdue").when(days_left <= 7, "week").when(days_left <= 31, "month").otherwise("later")


def series_summary(rows: DataFrame, key: str, order: list[str], amount: str) -> DataFrame:
    """Number, first and latest amount of a series and their change in per cent."""
    at = F.struct(*order)
    s = rows.groupBy(key).agg(F.count("*").alias("n"), F.min_by(amount, at).alias("first_amount"), F.max_by(amount, at).alias("latest_amount"))
    return s.withColumn("pct", F.round((F.col("latest_amount") - F.col("first_amount")) / F.col("first_amount") * 100, 1))


def largest_remainder(rows: DataFrame, group: str, key: list[str], weight: str, total: Column) -> DataFrame:
    """Whole-number shares of ``total`` by ``weight``: floors, then one more for
    the largest fractions (ties by key) until they add up."""
    whole = F.sum(weight).over(Window.partitionBy(group))
    exact = total * F.col(weight) / whole
    parts = rows.withColumns({"_floor": F.floor(exact), "_rest": total * F.col(weight) - F.floor(exact) * whole, "_total": total})
    left = F.col("_total") - F.sum("_floor").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_rest"), *key))
    return parts.withColumn("share", (F.col("_floor") + F.when(place <= left, 1).otherwise(0)).cast("bigint")).drop("_floor", "_rest", "_total")
