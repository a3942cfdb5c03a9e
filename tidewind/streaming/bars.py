"""Daily bars and activity sessions of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bars(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Bars of (ts, event_id, value) by tumbling window, on a stream or a batch.

    On a stream, events later than the watermark are left out, as a published
    day is never revised.
    """
    at = F.struct("ts", "event_id")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    bars = rows.groupBy(F.window("ts", width)).agg(
        F.min_by("value", at).alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"), F.max_by("value", at).alias("Close"), F.count("*").alias("Volume")
    )
    return bars.select(F.to_date("window.start").alias("Date"), "Open", "High", "Low", "Close", "Volume")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a key's events with gaps below ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return out.select(key, F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n_events", "total")
