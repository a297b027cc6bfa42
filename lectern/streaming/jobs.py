"""Structured Streaming forms of the stateful rules.

Each job is a function from a streaming DataFrame to a streaming DataFrame.
``run_once`` drives one over a table with ``availableNow``: it is how the batch
tables test them; in service the same functions get a ``readStream`` of files or
a queue and a ``writeStream`` of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import scratch

def run_once(table: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Write ``table`` to a folder, stream it through ``job`` until it is used up,
    and return what came out."""
    spark, base = table.sparkSession, scratch(table.sparkSession, f"stream-{job.__name__}")
    table.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{base}/in")
    out, path = job(stream), f"{base}/out"
    writer = out.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        started = writer.format("parquet").outputMode("append").start(path)
    else:  # a complete or update result replaces the last one
        started = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    started.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def windowed_counts(events: DataFrame) -> DataFrame:
    """Events by type in windows of six hours, late by ten minutes at most."""
    timed = events.select(F.col("ts").cast("timestamp").alias("at"), "event_type").withWatermark("at", "10 minutes")
    counts = timed.groupBy(F.window("at", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def daily_notices(events: DataFrame) -> DataFrame:
    """The first notice of a key and day; repeats inside the watermark are dropped."""
    keyed = events.select("user_id", "event_type", F.to_date("ts").alias("day"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at"))
    return keyed.withWatermark("at", "40 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Sessions of a user, closed by a silence of ``gap``."""
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", gap)
    s = timed.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def page_changes(looks: DataFrame) -> DataFrame:
    """baseline, same, changed or blocked for each look; the last good hash of a
    page is the state that lives on between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("event_id")
        said = []
        for kind, value in zip(rows["event_type"], rows["value"]):
            if kind == "error":
                said.append("blocked")
                continue
            now = int(round(value)) % 3
            said.append("baseline" if before is None else "same" if before == now else "changed")
            before = now
        if before is not None:
            state.update((before,))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "state": said})

    rows = looks.select("user_id", "event_id", "event_type", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, state string", "hash bigint", "append", GroupStateTimeout.NoTimeout)


def matched(left: DataFrame, right: DataFrame, key: str, within: str) -> DataFrame:
    """Stream-stream join: right rows at most ``within`` after a left row of the key."""
    a = left.withWatermark("at", within).alias("a")
    b = right.withWatermark("at", within).alias("b")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.at") >= F.col("a.at")) & (F.col("b.at") <= F.col("a.at") + F.expr(f"interval {within}"))
    return a.join(b, near).select(F.col(f"a.{key}"), F.col("a.at").alias("at"), F.col("b.at").alias("answered"))
