"""Places in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their 1-based place in ``order`` (best a unique one: rows that
    are equal in it stand together in one partition). Rows are dealt by range,
    sorted within partitions and written; a place is the place in its partition
    plus the sizes of those before, of which the driver sees one number each."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialise(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for i, n in sorted(tuple(r) for r in written.groupBy(part.alias("part")).count().collect()):
        starts.append((i, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return written.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_part", "_start", "_at")


def paged(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with ``page`` (from 0) in ascending ``key`` order and
    ``next_cursor``, the last key of the page where another one follows."""
    placed = numbered(rows, [F.asc(key)]).withColumn("page", F.floor((F.col("place") - 1) / size))
    last = placed.groupBy("page").agg(F.max(key).alias("_last"))
    more = placed.agg(F.max("page").alias("_pages"))  # one row
    cursors = last.join(F.broadcast(more)).select("page", F.when(F.col("page") < F.col("_pages"), F.col("_last")).alias("next_cursor"))
    return placed.drop("place").join(cursors, "page")
