"""A hashing embedder: deterministic, without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_vectors(rows: DataFrame, keys: list[str], text: str, size: int = 32) -> DataFrame:
    """(keys, d, x): the non-zero places of each text's unit vector. A bag of
    words: bytes 0 and 1 of a word's MD5 choose places that gain 1 and a half."""
    words = rows.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    digest = F.md5("w")
    place = lambda byte: F.conv(F.substring(digest, 2 * byte + 1, 2), 16, 10).cast("int") % size
    gains = F.array(F.struct(place(0).alias("d"), F.lit(1.0).alias("x")), F.struct(place(1).alias("d"), F.lit(0.5).alias("x")))
    sums = words.select(*keys, F.explode(gains).alias("g")).groupBy(*keys, F.col("g.d").alias("d")).agg(F.sum("g.x").alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*keys)))
    return sums.withColumn("x", F.col("x") / length)
