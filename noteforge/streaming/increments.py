"""Incremental operators; extensions for vaults that change while they are watched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values by type in tumbling windows; on a stream, rows later than `late` are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "events", "total")


def first_of_content(files: DataFrame, key: str = "hash", late: str = "1 hour") -> DataFrame:
    """A stream's files without those whose content came within `late` before; state is dropped with the watermark."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return by.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
