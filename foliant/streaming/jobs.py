"""Job logs as streams: running state with TTL, progress, and idle sessions. Additive: batch queries give the same answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(log: DataFrame, column: str = "at", late: str = "10 minutes") -> DataFrame:
    """Event time as TIMESTAMP with a watermark; a zone-less time is taken in the session's zone."""
    return log.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def running_state(log: DataFrame) -> DataFrame:
    """Last status and event count of each job, for update or complete mode."""
    s = F.when(F.col("event") != "checkpoint", F.col("seq"))
    return timed(log).groupBy("job_id").agg(F.max_by("event", s).alias("status"), F.count(F.lit(1)).alias("events"), F.max("at").alias("updated_at"))


def hourly_events(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events by kind in windows of event time; append mode emits a window once the watermark has passed it."""
    return timed(log).groupBy(F.window("at", width), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def idle_sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of activity of each job, parted by silence."""
    return timed(log).groupBy(F.session_window("at", gap), "job_id").agg(F.count(F.lit(1)).alias("n")).select("job_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
