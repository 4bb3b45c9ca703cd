"""An extension: windowed counts over the events table, the same expression in batch and in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by window and type; on a stream, windows close `late` behind the newest event."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users that end after `gap` without an event."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", gap) if events.isStreaming else events
    s = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("s.start").alias("session_start"), "n", "total")


def stream(spark: SparkSession, folder: str, schema, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
