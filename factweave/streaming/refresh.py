"""Arriving references counted by window, and snapshots written whole before they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fact table as a stream of its files; the schema is that of the files there now."""
    at = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)


def reference_counts(refs: DataFrame, window: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """(start, kind, n) of a stream (or table) of references by the time they were seen, each `ref_id` once; rows that
    come later than `lateness` are dropped by a stream, rows without a time always."""
    timed = refs.where("seen_at is not null and ref_id is not null").select("ref_id", "kind", "seen_at")
    once = timed.withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["ref_id"]) if refs.isStreaming else timed.dropDuplicates(["ref_id"])
    counted = once.groupBy(F.window("seen_at", window).alias("w"), "kind").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "kind", "n")


def write_snapshot(tables: dict[str, DataFrame], root: str, snapshot_id: int) -> None:
    """All tables of a snapshot below root, then the row that makes it the current one: readers see the one before
    until everything is there. A snapshot that is written again replaces itself."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/snapshots/{snapshot_id}/{name}.parquet")
        spark = df.sparkSession
    ready = spark.createDataFrame([("READY",)], "status string")
    ready.write.mode("overwrite").parquet(f"{root}/ready/snapshot_id={snapshot_id}")


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest complete snapshot, or None."""
    try:
        newest = spark.read.parquet(f"{root}/ready").agg(F.max("snapshot_id")).head()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return f"{root}/snapshots/{newest}"
