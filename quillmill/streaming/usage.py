"""Streaming forms (an extension: the batch operators are the reference semantics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_stream(events: DataFrame, ts: str = "ts", user: str = "user", op: str = "op", late: str = "1 hour") -> DataFrame:
    """day_start, user, op, n of an event stream, with events up to ``late`` behind."""
    per = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), user, op).agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("day_start"), user, op, "n")


def burst_stream(events: DataFrame, limit: int = 12, period: str = "60 seconds", ts: str = "ts", user: str = "user", late: str = "10 minutes") -> DataFrame:
    """Windows in which a user made more calls than the limit."""
    per = events.withWatermark(ts, late).groupBy(F.window(ts, period).alias("w"), user).agg(F.count("*").alias("n"))
    return per.where(F.col("n") > limit).select(F.col("w.start").alias("window_start"), user, "n")
