"""Change detection over snapshots: files, pages, feeds, reminders.

Batch forms are joins, windows and aggregates; ``lectern.streaming`` runs the
same rules over streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_actions(known: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """skip, touch, replace, add or delete for each path of either snapshot, from
    columns size, mtime, hash: an unchanged size and time (within a microsecond)
    skips without a look at the hash."""
    k = known.select(key, *[F.col(c).alias(f"_k_{c}") for c in ("size", "mtime", "hash")], F.lit(1).alias("_k"))
    p = present.select(key, "size", "mtime", "hash", F.lit(1).alias("_p"))
    j = k.join(p, key, "full")
    same = (F.col("size") == F.col("_k_size")) & (F.abs(F.col("mtime") - F.col("_k_mtime")) <= 1e-6)
    action = F.when(F.col("_p").isNull(), "delete").when(F.col("_k").isNull(), "add").when(same, "skip").when(F.col("hash") == F.col("_k_hash"), "touch").otherwise("replace")
    return j.select(key, action.alias("action"))


def page_changes(snapshots: DataFrame, key: str, at: str, digest: Column, blocked: Column) -> DataFrame:
    """baseline, changed, same or blocked for each look at a page; a blocked look
    leaves the last good state as it is."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = snapshots.withColumns({"_h": F.when(~blocked, digest), "_b": blocked})
    before = F.last("_h", ignorenulls=True).over(w)
    state = F.when(F.col("_b"), "blocked").when(F.col("_before").isNull(), "baseline").when(F.col("_before") == F.col("_h"), "same").otherwise("changed")
    return rows.withColumn("_before", before).withColumn("state", state).drop("_h", "_b", "_before")


def new_items(items: DataFrame, feed: str, item: str, at: str, most: int) -> DataFrame:
    """First sightings in their order, at most ``most`` a feed and check, those of
    the feed's first check left out (the baseline)."""
    first = items.groupBy(feed, item).agg(F.min(at).alias(at))
    start = items.groupBy(feed).agg(F.min(at).alias("_start"))
    fresh = first.join(start, feed).where(F.col(at) > F.col("_start")).drop("_start")
    w = Window.partitionBy(feed, at).orderBy(item)
    return fresh.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def reminders(deadlines: DataFrame, day: str, today: str, leads: Column, notified: Column, overdue_days: int = 14) -> DataFrame:
    """Deadlines with the lead to announce today: the smallest lead whose day has
    come and that wasn't told yet; 0 for overdue ones of the last two weeks."""
    left = F.datediff(F.col(day), F.lit(today).cast("date"))
    due = F.array_min(F.filter(leads, lambda n: (n >= left) & ~F.array_contains(notified, n)))
    lead = F.when(left >= 0, due).when((left >= -overdue_days) & ~F.array_contains(notified, 0), 0)
    return deadlines.withColumns({"days_left": left.cast("bigint"), "lead": lead}).where(F.col("lead").isNotNull())


def pending(rows: DataFrame, done: DataFrame, key: str, batch: int) -> DataFrame:
    """Rows not done yet with the number of their batch (per partition of the key
    space, so that no single task numbers them all)."""
    left = rows.join(done, key, "left_anti")
    cell = F.pmod(F.xxhash64(key), F.lit(64))
    place = F.row_number().over(Window.partitionBy(cell).orderBy(key))
    return left.withColumns({"cell": cell, "batch": F.floor((place - 1) / batch).cast("bigint")})
