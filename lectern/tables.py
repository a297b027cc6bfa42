"""Loading the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Parquet gives Catalyst its filters and columns to push down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Tables of one folder by attribute: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def path(self, name: str) -> str:
        return f"{self._dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return load(self._spark, self._dir, name)
