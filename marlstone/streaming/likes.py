"""An extension: likes counted per window from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def likes_by_window(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(ts, user_id, event_type) to (window, event_type, n); rows later than ``late`` are left out. Works on a batch and on a stream."""
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    return windowed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
