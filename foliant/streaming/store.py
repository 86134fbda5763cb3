"""The job store as keyed state of a stream (T1 to T8): one value state for each job, event-time timers for its time to live, refused transitions as output.

A log may come in pieces, late, or out of order: a job remembers by which event each of its fields was set, so that what comes out in the end
is what a batch query over the whole log gives. Nothing but the latest state of each job is kept, however long its log."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import STATES
from ..sources.storage import shared_folder
from .jobs import timed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Why a job can't be run.
UNKNOWN, CANCELLED = "Unknown job", "Cancelled job cannot run"
#: Milliseconds of a day.
DAY = 86_400_000
#: Kinds of output rows: the state after some events, an event that was refused, a job that was deleted, one that outlived its time.
UPDATED, REFUSED, DELETED, EXPIRED = "updated", "refused", "deleted", "expired"
#: Fields of a job, each with the number of the event that set it.
FIELDS = ("status", "error", "result", "checkpoint")
#: Times, as microseconds: what a state and an input row make of a timestamp hangs on no zone.
TIMES = ("created_at", "updated_at")


def state_schema(log: T.StructType) -> T.StructType:
    kinds = {"status": T.StringType(), **{f: log[f].dataType for f in FIELDS[1:]}}
    return T.StructType([T.StructField(f, t) for f, t in kinds.items()] + [T.StructField(f"{f}_by", T.LongType()) for f in FIELDS] + [T.StructField(f, T.LongType()) for f in (*TIMES, "timer")])


def output_schema(log: T.StructType) -> T.StructType:
    kinds = {f.name: f.dataType for f in state_schema(log)}
    return T.StructType([log["job_id"], T.StructField("kind", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("reason", T.StringType()), *(T.StructField(f, kinds[f]) for f in (*FIELDS, *TIMES))])


def applied(job: dict | None, event: dict) -> dict:
    """A job after one more event. A status sets the error as well, to null if the event has none; results and checkpoints stay until there is another
    one. What an event with a higher number has set stays."""
    job = dict(job) if job else {**dict.fromkeys(FIELDS), **{f"{f}_by": -1 for f in FIELDS}, **dict.fromkeys(TIMES, event["us"]), "timer": -1}
    status = "pending" if event["event"] == "created" else event["event"] if event["event"] in STATES else None
    given = {"status": status, "error": event["error"], "result": event["result"], "checkpoint": event["checkpoint"]}
    for field, value in given.items():
        counts = status is not None if field in ("status", "error") else value is not None
        if counts and event["seq"] > job[f"{field}_by"]:
            job[field], job[f"{field}_by"] = value, event["seq"]
    job["created_at"], job["updated_at"] = min(job["created_at"], event["us"]), max(job["updated_at"], event["us"])
    return job


def refusal(job: dict | None, event: str) -> str | None:
    """Why an event can't happen to a job (T8): only a known job that isn't cancelled runs."""
    if event != "running":
        return None
    return UNKNOWN if job is None else CANCELLED if job["status"] == "cancelled" else None


class JobStore(StatefulProcessor):
    """``guarded``: refuse runs of unknown or cancelled jobs; else every event counts, as in the batch query. ``days``: how long a job lives after its
    last event, whatever its status (T6); null: for ever."""

    def __init__(self, log: T.StructType, guarded: bool, days: int | None) -> None:
        self.fields, self.guarded, self.days = state_schema(log), guarded, days
        self.out = Row(*output_schema(log).names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", self.fields)

    def _said(self, key: tuple, kind: str, job: dict | None, seq: int | None = None, reason: str | None = None) -> Row:
        return self.out(key[0], kind, seq, reason, *((job or {}).get(f) for f in (*FIELDS, *TIMES)))

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        job = dict(zip(self.fields.names, self.job.get(), strict=True)) if self.job.exists() else None
        before, last = job, None
        for event in sorted((r.asDict() for r in rows), key=lambda e: e["seq"]):
            reason = refusal(job, event["event"]) if self.guarded else None
            if reason:
                yield self._said(key, REFUSED, job, event["seq"], reason)
            elif event["event"] == "deleted":
                yield self._said(key, DELETED, job, event["seq"])
                job = None
            else:
                job, last = applied(job, event), event["seq"]
        self._keep(before, job)
        if job is not None and job is not before:
            yield self._said(key, UPDATED, job, last)

    def _keep(self, before: dict | None, job: dict | None) -> None:
        timer = -1
        if job is not None and self.days is not None:
            timer = job["updated_at"] // 1000 + self.days * DAY
        if before is not None and before["timer"] not in (-1, timer):
            self.handle.deleteTimer(before["timer"])
        if timer != -1 and (before is None or before["timer"] != timer):
            self.handle.registerTimer(timer)
        if job is None:
            if before is not None:
                self.job.clear()
        elif job is not before:
            self.job.update(tuple((job | {"timer": timer})[f] for f in self.fields.names))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.job.exists():
            job = dict(zip(self.fields.names, self.job.get(), strict=True))
            self.job.clear()
            yield self._said(key, EXPIRED, job)

    def close(self) -> None:
        pass


def job_store(log: DataFrame, guarded: bool = True, days: int | None = None) -> DataFrame:
    """Output rows of the store over a stream of a job log (``job_id, seq, at, event, error, result, checkpoint``): ``job_id, kind, seq, reason`` and the job.

    Jobs expire by event time, once the watermark has passed their limit. The session needs the state store that keeps timers (``PROVIDER``)."""
    events = timed(log).withColumn("us", F.unix_micros("at"))
    out = events.groupBy("job_id").transformWithState(JobStore(log.schema, guarded, days), output_schema(log.schema), "Append", "EventTime" if days is not None else "None")
    return out.withColumns({t: F.timestamp_micros(t) for t in TIMES})


def replayed(spark: SparkSession, folder: str, guarded: bool = True, days: int | None = None, files: int = 1) -> DataFrame:
    """All output rows of the store over the log files in a folder, ``files`` at a time, until none is left. The rows are written, each with the number of
    the micro-batch that gave it (``batch``)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    log = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).parquet(folder)
    out = shared_folder(spark, "jobs")
    write = lambda rows, batch: rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/rows/part={batch}")  # noqa: E731  a batch that is run again replaces itself
    query = job_store(log, guarded, days).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([T.StructField(f.name, T.TimestampType()) if f.name in TIMES else f for f in output_schema(log.schema)] + [T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


def latest(rows: DataFrame) -> DataFrame:
    """The jobs that are left: of each, its last state, unless it was deleted or expired after that."""
    states = rows.where(F.col("kind") != REFUSED)
    rest = [c for c in rows.columns if c not in ("job_id", "batch", "seq", "reason")]
    order = F.struct("batch", (F.col("kind") == UPDATED).cast("int"), F.coalesce("seq", F.lit(-1)))
    last = states.groupBy("job_id").agg(F.max_by(F.struct(*rest), order).alias("j"))
    return last.select("job_id", "j.*").where(F.col("kind") == UPDATED).drop("kind")
