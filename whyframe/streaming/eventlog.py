"""The event log as a stream: counts by type in event-time windows, with a watermark for late lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.eventlog import SCHEMA


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path).withColumn("time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


def counts_by_window(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window start, type, n): state is bounded by the watermark."""
    counted = events.withWatermark("time", late).groupBy(F.window("time", window).alias("w"), "type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "type", "n")
