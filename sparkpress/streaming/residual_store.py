"""Residual store: batch expiry, and the same as a stream with watermarks (an extension: the store itself is an in-memory cache elsewhere)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alive(residuals: DataFrame, ttl: int) -> DataFrame:
    """(session, handle, text) of residuals stored at most ttl before their session's last."""
    last = F.max("stored_at").over(Window.partitionBy("session"))
    return residuals.withColumn("age", last - F.col("stored_at")).where(F.col("age") <= ttl).select("session", "handle", "text")


def expand(residuals: DataFrame, handles: DataFrame) -> DataFrame:
    """The residuals that handles(session, handle) ask for."""
    return residuals.join(handles, ["session", "handle"], "left_semi")


def template_counts(lines: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, mask, n) of a stream of (ts, mask): log templates by event time, late lines up to the watermark."""
    return lines.withWatermark("ts", late).groupBy(F.window("ts", window), "mask").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(residuals: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of residuals (ts, session, handle, text), each handle once within the watermark: state is bounded by the time to live."""
    return residuals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "handle"])
