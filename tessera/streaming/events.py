"""Windows over an event stream; every function takes a batch or a streaming table (ts, ...) alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str) -> DataFrame:
    # a watermark needs an instant; a timestamp without a zone is taken in the session's
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """(window_start, key, n, value): counts and sums of each window of fixed width."""
    grouped = _late(events, delay).groupBy(F.window("ts", width).alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), key, "n", "value")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", delay: str = "10 minutes", key: str = "event_type") -> DataFrame:
    grouped = _late(events, delay).groupBy(F.window("ts", width, step).alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), key, "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's events without a gap of that length."""
    grouped = _late(events, delay).groupBy(F.session_window("ts", gap).alias("s"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
