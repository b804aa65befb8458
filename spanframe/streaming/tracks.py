"""Streaming forms of track aggregation: an unbounded table of events becomes a track as time passes.

The batch operators have no notion of late data; here a watermark bounds the state, as sorted input bounds that
of a sweep over positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_track(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Mean, count and largest value by event_type and time window; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = timed.groupBy(window.alias("w"), F.col("event_type").alias("chrom")).agg(F.avg("value").alias("value"), F.count("*").alias("n"), F.max("value").alias("high"))
    return grouped.select("chrom", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "n", "high")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Islands in time: runs of a user's events with less than gap between them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
