"""Names, joins and Arrow helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, scratch

__all__ = ["CACHES", "SLICE_BYTES", "SPACES", "crc_mod", "drop_caches", "fresh", "give_back", "join_groups", "map_arrow", "materialise", "scratch", "slices", "table", "text_bytes"]

#: ASCII white space as the contracts define it.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that a worker turns into Python objects at a time.
SLICE_BYTES = 8 << 20


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no column of ``tables`` begins so (in any case)."""
    taken = [c.lower() for df in tables for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


#: Groups that ``join_groups`` sends to every task; no other one holds more than
#: one row in so many.
HOT_GROUPS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, spread, most: int = HOT_GROUPS) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row a value of ``on``, none of
    it null, best a written table) less its column ``size``, the number of rows
    of the group. The ``most`` largest groups are broadcast, so that a group that
    holds a third of all rows is never dealt to one task; their rows are dealt by
    ``spread`` and meet nothing there."""
    told = [c for c in groups.columns if c not in (on, size)]
    head = fresh("__", rows, groups)
    hot_key, cold_key, dealt_by = F.col(f"{head}hot"), F.col(f"{head}cold"), f"{head}key"
    hot = groups.orderBy(F.desc(size), on).limit(most).select(F.col(on).alias(f"{head}hot"), *[F.col(c).alias(f"{head}hot_{c}") for c in told])
    other = F.xxhash64(spread)
    if groups.schema[on].dataType.typeName() == "binary":
        other = other.cast("string").cast("binary")
    cold = groups.join(F.broadcast(hot.select(f"{head}hot")), F.col(on) == hot_key, "left_anti")
    cold = cold.select(F.col(on).alias(f"{head}cold"), *[F.col(c).alias(f"{head}cold_{c}") for c in told])
    dealt = rows.join(F.broadcast(hot), F.col(on) == hot_key, "left").withColumn(dealt_by, F.when(hot_key.isNull(), F.col(on)).otherwise(other))
    joined = dealt.join(cold, F.col(dealt_by) == cold_key, "left")
    value = lambda c: F.when(hot_key.isNull(), F.col(f"{head}cold_{c}")).otherwise(F.col(f"{head}hot_{c}")).alias(c)
    return joined.select(*rows.columns, *[value(c) for c in told])


#: What workers remember from task to task, by operator: how to drop it.
CACHES: dict[str, Callable[[], None]] = {}


def drop_caches(keeps: str) -> None:
    """Clear what other operators remember in this worker."""
    for name, drop in CACHES.items():
        if name != keeps:
            drop()


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run, schema, keeps: str = "") -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers, which live on from task to
    task, hold no more than the memory of ``keeps`` when they begin, and give
    back what they have freed when they end."""

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(frugal, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of each row of a string or binary column, null as ``b''``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type in (pa.large_string(), pa.large_binary()):
        width = np.int64
    else:
        column, width = column.cast(pa.binary()) if column.type != pa.string() else column, np.int32
    n = len(column)
    if not n:
        return []
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], dtype=width)[column.offset : column.offset + n + 1].tolist()
    data = memoryview(buffers[2] or b"")
    rows = [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
    if column.null_count:
        rows = [r if ok else b"" for r, ok in zip(rows, column.is_valid().to_pylist())]
    return rows


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the ``text`` column of each piece holds at
    most ``most`` bytes (a longer single row stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        width = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
        ends = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = to
