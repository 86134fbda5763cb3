"""Job state from an append-only event log (T1 to T9). Deletions are events too; nothing is updated in place.

Log: ``job_id, seq, at, event, error, result, checkpoint``; events: created, pending, running, checkpoint, completed,
failed, cancelled."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ["pending", "running", "completed", "failed", "cancelled"]


def job_state(log: DataFrame) -> DataFrame:
    """The state of each job (T2 to T4): last status, the error that came with it (none clears it), the last result and
    checkpoint that aren't null. Partial aggregates, so a job with very many events is no burden."""
    status = F.when(F.col("event") == "created", "pending").when(F.col("event").isin(STATES), F.col("event"))
    last = lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
    s = log.withColumn("status", status)
    return s.groupBy("job_id").agg(
        last(F.col("status"), F.col("status").isNotNull()).alias("status"), last(F.col("error"), F.col("status").isNotNull()).alias("error"), last(F.col("result"), F.col("result").isNotNull()).alias("result"),
        last(F.col("checkpoint"), F.col("checkpoint").isNotNull()).alias("checkpoint"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"),
    )


def created(requests: DataFrame) -> DataFrame:
    """First log rows of new jobs (T1): pending, without error, result or checkpoint. ``requests``: ``job_id, at`` and what describes the job; ids come from the caller, so that
    a job that is asked for twice is one job."""
    rest = [c for c in requests.columns if c not in ("job_id", "at")]
    null = lambda kind: F.lit(None).cast(kind)
    return requests.select("job_id", F.lit(0).cast("long").alias("seq"), "at", F.lit("created").alias("event"), null("string").alias("error"), null("string").alias("result"), null("long").alias("checkpoint"), *rest)


def artifact_names(artifacts: DataFrame) -> DataFrame:
    """``artifacts`` (``job_id, name``) with ``leaf``, the name that they may be saved under within the job's folder, or null and an ``error`` (T5)."""
    leaf = F.regexp_extract(F.regexp_replace("name", r"[/\\\\]+$", ""), r"([^/\\\\]*)$", 1)
    bad = (leaf == "") | leaf.isin(".", "..")
    return artifacts.withColumns({"leaf": F.when(~bad, leaf), "error": F.when(F.coalesce(bad, F.lit(True)), "Artifact name must be a file name")})


def recoverable(state: DataFrame) -> DataFrame:
    return state.where("status in ('pending', 'running')")


def kept_after_purge(state: DataFrame, as_of: datetime | str, days: int = 7) -> DataFrame:
    """Jobs that a purge leaves: those updated at or after its limit, whatever their status."""
    return state.where(F.col("updated_at") >= F.lit(str(as_of)).cast("timestamp") - F.expr(f"interval {days} days"))


def newest_first(state: DataFrame) -> DataFrame:
    return state.orderBy(F.col("created_at").desc(), "job_id")


def grid(first: Column, last: Column) -> Column:
    """Page range as shown in the list of jobs; an open end reads ``end``."""
    return F.concat(F.coalesce(first, F.lit(1)).cast("string"), F.lit("-"), F.coalesce(last.cast("string"), F.lit("end")))


def rejected_runs(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs that may not be run: unknown or cancelled ones."""
    met = wanted.select("job_id").join(state.select("job_id", "status"), "job_id", "left")
    return met.withColumn("reason", F.when(F.col("status").isNull(), "unknown job").when(F.col("status") == "cancelled", "cancelled job")).where("reason is not null")
