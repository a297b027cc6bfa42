"""Writers: subtitles, calendars and packs of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stamp(seconds: Column, mark: str) -> Column:
    ms = F.round(seconds * 1000).cast("bigint")
    part = lambda n, size: F.lpad(n.cast("string"), size, "0")
    return F.concat(part(F.floor(ms / 3_600_000), 2), F.lit(":"), part(F.floor(ms / 60_000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit(mark), part(ms % 1000, 3))


def _joined(rows: DataFrame, key: str, order: str, piece: Column, glue: str) -> DataFrame:
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), piece.alias("x")))).alias("_p"))
    return g.select(key, F.array_join(F.transform("_p", lambda p: p["x"]), glue).alias("text"))


def srt(cues: DataFrame, key: str, order: str, start: str, end: str, text: str) -> DataFrame:
    """(key, text): one subtitle text for each recording."""
    head = F.concat((F.col(order) + 1).cast("string"), F.lit("\n"), _stamp(F.col(start), ","), F.lit(" --> "), _stamp(F.col(end), ","), F.lit("\n"))
    return _joined(cues, key, order, F.concat(head, F.col(text)), "\n\n")


def vtt(cues: DataFrame, key: str, order: str, start: str, end: str, text: str) -> DataFrame:
    head = F.concat(_stamp(F.col(start), "."), F.lit(" --> "), _stamp(F.col(end), "."), F.lit("\n"))
    body = _joined(cues, key, order, F.concat(head, F.col(text)), "\n\n")
    return body.withColumn("text", F.concat(F.lit("WEBVTT\n\n"), "text"))


def lrc(cues: DataFrame, key: str, order: str, start: str, text: str) -> DataFrame:
    cs = F.round(F.col(start) * 100).cast("bigint")
    part = lambda n: F.lpad(n.cast("string"), 2, "0")
    head = F.concat(F.lit("["), part(F.floor(cs / 6000)), F.lit(":"), part(F.floor(cs / 100) % 60), F.lit("."), part(cs % 100), F.lit("]"))
    return _joined(cues, key, order, F.concat(head, F.col(text)), "\n")


def ics(events: DataFrame, key: str, uid: Column, day: Column, summary: Column) -> DataFrame:
    """(key, text): one calendar of whole-day events for each key."""
    escaped = F.regexp_replace(summary, r"([,;\\])", r"\\$1")
    event = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), uid, F.lit("\r\nDTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd"), F.lit("\r\nSUMMARY:"), escaped, F.lit("\r\nEND:VEVENT\r\n"))
    body = _joined(events.withColumns({"_u": uid, "_e": event}), key, "_u", F.col("_e"), "")
    return body.withColumn("text", F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//lectern//EN\r\n"), "text", F.lit("END:VCALENDAR\r\n")))


def write_pack(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each table as semicolon-separated CSV below ``folder``, and their manifest (name, rows)."""
    counts = None
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("sep", ";").csv(f"{folder}/{name}")
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        counts = row if counts is None else counts.unionByName(row)
    return counts
