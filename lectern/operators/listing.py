"""Listing operators: keyset pages, neighbours, state and date predicates, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The ``size`` rows behind ``after`` in ascending ``key`` order and whether
    more follow (``has_more``), found by looking one row ahead."""
    page = rows if after is None else rows.where(F.col(key) > F.lit(after))
    ahead = page.orderBy(key).limit(size + 1)
    place = F.row_number().over(Window.orderBy(key))  # size + 1 rows at most
    return ahead.withColumns({"_place": place, "has_more": F.count("*").over(Window.partitionBy()) > size}).where(F.col("_place") <= size).drop("_place")


def offset_page(rows: DataFrame, order: list[Column], size: int, offset: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def with_neighbours(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """``previous_<key>``, ``next_<key>`` and ``total`` of each row in its group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumns({f"previous_{key}": F.lag(key).over(w), f"next_{key}": F.lead(key).over(w), "total": F.count("*").over(Window.partitionBy(group))})


def contains_folded(text: Column, part: str) -> Column:
    """ASCII case-insensitive containment."""
    return F.lower(text).contains(part.lower())


def between_or_undated(day: Column, since: str | None, until: str | None) -> Column:
    """Rows without a date always pass."""
    ok = F.lit(True)
    if since:
        ok = ok & (day >= F.lit(since).cast("date"))
    if until:
        ok = ok & (day <= F.lit(until).cast("date"))
    return day.isNull() | ok


def is_due(last: Column, now: str, every_seconds: Column, enabled: Column) -> Column:
    """Enabled, and never run or run at least ``every_seconds`` ago."""
    elapsed = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last)
    return enabled & (last.isNull() | (elapsed >= every_seconds))


def redact(settings: Column, secret_names: tuple[str, ...]) -> Column:
    """A string map with the values of secret names masked, empty ones kept empty."""
    secret = "|".join(secret_names)
    return F.transform_values(settings, lambda k, v: F.when(F.lower(k).rlike(secret) & (F.length(v) > 0), F.lit("***")).otherwise(v))


def missing_ids(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Ids asked for that are not there."""
    return wanted.join(found, key, "left_anti").select(key).distinct()
