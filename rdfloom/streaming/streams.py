"""Structured Streaming forms of the audit: file streams, windows, late rows, running profiles, latest per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rdfloom.operators.registry import latest_per_key


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of a directory as a stream with a known schema."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", str(files_a_batch)).parquet(path)


def tumbling(events: DataFrame, time: str, size: str, late: str, *by: str, value: str | None = None) -> DataFrame:
    """Counts (and sums) by window and group; rows later than the watermark are dropped on a stream."""
    extra = [F.sum(value).alias("total")] if value else []
    return events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("events"), *extra).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "events", *(["total"] if value else [])
    )


def sliding(events: DataFrame, time: str, size: str, step: str, late: str, *by: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size, step), *by).agg(F.count("*").alias("events")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "events"
    )


def sessions(events: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("events")).select(
        F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "events"
    )


def first_deliveries(rows: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """Rows without those delivered again within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else rows.dropDuplicates(list(keys))


def running_profile(rows: DataFrame, keys: list[str], form: str) -> DataFrame:
    """Counts of each component's forms, for ``update`` output; profiles are built on what is written."""
    return rows.groupBy(*keys, form).agg(F.count("*").alias("n"))


def upsert_latest(path: str, keys: list[str], *order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row per key, one directory a version: batch n reads n - 1, so a retried batch gives the same result."""
    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = batch
        if number:
            known = spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}").unionByName(batch)
        latest_per_key(known, keys, *order).write.mode("overwrite").parquet(f"{path}/version={number}")

    return sink
