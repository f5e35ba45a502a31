"""Event-time summaries of a reading stream; the same code serves static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(readings: DataFrame, time: str, delay: str) -> DataFrame:
    return readings.withWatermark(time, delay) if readings.isStreaming else readings


def window_summary(
    readings: DataFrame, size: str, slide: str | None = None, time: str = "ts", delay: str = "2 hours"
) -> DataFrame:
    """Count, mean and population std per variable in tumbling or sliding windows."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    return _watermarked(readings, time, delay).groupBy(span.alias("w"), "variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             "variable", "n", "mean", "std")


def run_sessions(readings: DataFrame, gap: str, time: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Stretches of activity per batch: a pause longer than ``gap`` ends one.

    In append mode a session comes out, and its state leaves, when the watermark has
    passed its end.  Rows with an empty batch_id only move the watermark (a heartbeat),
    so that the last sessions of a source that pauses come out too.
    """
    # the condition names the event time, so that Spark does not move it below the watermark
    told = (F.col("batch_id") != "") | F.col(time).isNull()
    return _watermarked(readings, time, delay).where(told).groupBy(
        F.session_window(time, gap).alias("w"), "batch_id"
    ).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(
        "batch_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
        "n", "mean")
