"""Arrow batches in parts of bounded size.

Spark cuts the batches that it sends to Python by rows or by megabytes, and a
batch of long texts becomes many times its size as Python objects. What is mapped
over ``slices`` holds the objects of one part at a time, whatever a batch holds; a
row that is larger than a part is a part of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes and rows of a part, about.
PART_BYTES, PART_ROWS = 1 << 20, 1000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, a part at a time."""
    rows = batch.num_rows
    if not rows:
        return
    if batch.nbytes <= PART_BYTES and rows <= PART_ROWS:
        yield batch
    elif rows == 1:
        yield batch
    else:
        half = rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of all batches; a batch is let go before the next one is read."""
    for batch in batches:
        yield from slices(batch)
        del batch


def map_frames(rows: DataFrame, run: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``rows.mapInPandas(run, schema)`` with small frames."""
    kind = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for part in parts(batches):
            yield part.to_pandas()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(frames(batches)):
            yield from pa.Table.from_pandas(frame, schema=kind, preserve_index=False).to_batches()

    return rows.mapInArrow(mapped, schema)
