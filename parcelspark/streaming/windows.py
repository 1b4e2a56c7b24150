"""The same window aggregations on batch and streaming events, and an available-now run of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    grouped = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    out = grouped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "7 days", step: str = "1 day") -> DataFrame:
    grouped = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    return grouped.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    out = grouped.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is available now, written as Parquet, then stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
