"""Streaming extension: windowed leaders of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, best) of each window; the same on a batch and on a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "best")
