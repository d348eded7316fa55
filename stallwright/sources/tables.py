"""The tables that queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Parquet tables of a folder, by attribute: ``Tables(spark, path).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
