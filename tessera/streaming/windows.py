"""Windows over event time; each function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since(unit: str, column: str) -> Column:
    """Whole units from the beginning of 1970 to a time without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream needs a time with a zone for its watermark: zone-less ones are taken as they stand, in the session's zone."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of windows; on a stream, rows more than `late` behind are dropped."""
    made = watermarked(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))
    return made.select(since("SECOND", "w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    made = watermarked(events, late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return made.select(since("SECOND", "w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(user_id, start_us, n): runs of a user's events less than `gap` apart."""
    made = watermarked(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return made.select("user_id", since("MICROSECOND", "w.start").alias("start_us"), "n")
