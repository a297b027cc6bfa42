"""Vectors as packed little-endian float32 bytes, whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def pack(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, packed)."""

    def run(batches):
        for batch in batches:
            values = batch.column(1)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
            ends = np.cumsum([0, *(4 * len(v) for v in values.to_pylist())]).tolist()
            yield pa.record_batch([batch.column(0), pa.array([flat[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], names=[key, "packed"])

    return rows.select(key, vector).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, packed binary")


def unpack(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n_bytes, vector) from packed bytes."""

    def run(batches):
        for batch in batches:
            data = batch.column(1).to_pylist()
            vectors = [np.frombuffer(d, "<f4").astype(float) for d in data]
            yield pa.record_batch([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))], names=[key, "n_bytes", vector])

    return rows.select(key, "packed").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, n_bytes bigint, {vector} array<double>")
