"""Loading of the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One fact table of a snapshot folder, whole."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
