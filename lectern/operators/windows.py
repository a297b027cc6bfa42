"""Window-shaped operators: histories, sessions, gaps, deduplication by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def price_history(rows: DataFrame, keys: list[str], order: list[Column], amount: str) -> DataFrame:
    """``change`` and ``pct`` against the last non-null amount before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(amount, ignorenulls=True).over(w)
    out = rows.withColumn("previous", before)
    delta = F.col(amount) - F.col("previous")
    return out.withColumns({"change": F.round(delta, 2), "pct": F.when(F.col("previous") != 0, F.round(delta / F.col("previous") * 100, 1))})


def price_alerts(rows: DataFrame, keys: list[str], order: list[Column], reverse: list[Column], amount: str, threshold: float) -> DataFrame:
    """Newest rows of their series whose amount rose by ``threshold`` per cent or
    more; falls never alert."""
    history = price_history(rows, keys, order, amount)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*reverse))
    return history.withColumn("_newest", newest).where((F.col("_newest") == 1) & (F.col("pct") >= threshold)).drop("_newest")


def min_max_scaled(rows: DataFrame, leg: str, score: str) -> DataFrame:
    """``scaled`` in 0..1 within its leg; 1 where all scores are equal."""
    w = Window.partitionBy(leg)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("scaled", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0)))


def gap_groups(rows: DataFrame, keys: list[str], order: list[Column], starts: Column, name: str) -> DataFrame:
    """Numbers groups from 0 in order; a row for which ``starts`` holds begins a
    new one (``starts`` may use lag over the same window)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_s", F.coalesce(starts, F.lit(False)).cast("int")).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_s")


def duplicates_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every row with the flag ``kept``: the first of its key stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("kept", F.row_number().over(w) == 1)


def stable_pick(rows: DataFrame, key: str, day: str, score: Column, n: int) -> DataFrame:
    """The ``n`` best by score; ties in an order that changes with the day only."""
    draw = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{day}:"), F.col(key).cast("string"))), 1, 4), 16, 10).cast("bigint")
    return rows.withColumns({"score": score, "draw": draw}).orderBy(F.desc("score"), F.desc("draw"), key).limit(n)


def timed_paragraphs(cues: DataFrame, key: str, order: str, start: str, end: str, text: str, gap: float = 2.0, length: float = 30.0, longest: float = 60.0) -> DataFrame:
    """Paragraphs of timed lines as (key, paragraph, start, end, text): a new one
    after a silence of ``gap`` seconds, at a sentence end once ``length`` seconds
    long, and at ``longest`` seconds at the latest. A fold over one recording's
    ordered lines, which is the state it needs."""
    line = F.struct(F.col(order).alias("o"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.col(text).alias("t"))
    kind = "array<struct<s:double,e:double,t:string>>"

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        ended = last["t"].rlike(r"[.!?…]$")
        fresh = (F.size(done) == 0) | (x["s"] - last["e"] >= gap) | ((last["e"] - last["s"] >= length) & ended) | (x["e"] - last["s"] > longest)
        new = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))
        grown = F.array(F.struct(last["s"].alias("s"), x["e"].alias("e"), F.concat(last["t"], F.lit(" "), x["t"]).alias("t")))
        return F.when(fresh, F.concat(done, new)).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), grown))

    folded = cues.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("_l"))
    safe = lambda done, x: F.when(F.size(done) == 0, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))).otherwise(add(done, x))
    out = folded.select(key, F.posexplode(F.aggregate("_l", F.array().cast(kind), safe)).alias("paragraph", "p"))
    return out.select(key, F.col("paragraph").cast("bigint").alias("paragraph"), F.col("p.s").alias("start"), F.col("p.e").alias("end"), F.col("p.t").alias("text"))


def spaced(rows: DataFrame, key: str, at: Column, order: str, gap: float, name: str = "starts") -> DataFrame:
    """``rows`` with the earliest time at which each may start: not before it comes,
    nor less than ``gap`` after the one before it of its key (politeness to a host).
    The recurrence s(i) = max(a(i), s(i - 1) + gap) is a running maximum of
    a(i) - i * gap, so it is one window."""
    w = Window.partitionBy(key).orderBy(at, order)
    placed = rows.withColumns({"_a": at, "_i": F.row_number().over(w)})
    latest = F.max(F.col("_a") - F.col("_i") * F.lit(gap)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, latest + F.col("_i") * F.lit(gap)).drop("_a", "_i")
