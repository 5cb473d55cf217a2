"""Readers of the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table *name* of *folder*; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
