"""Streams of job events give what batch queries give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.sources import fixtures
from foliant.operators import jobs
from foliant.streaming import jobs as stream_jobs
from foliant.streaming import store

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    fixtures.job_log(spark, DATA).repartition(3).write.mode("overwrite").parquet(path)
    return path


def run(spark, folder, make, mode, name):
    log = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    q = make(log).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_running_state(spark, folder):
    got = {(r.job_id, r.status, r.events) for r in run(spark, folder, stream_jobs.running_state, "complete", "state").collect()}
    batch = spark.read.parquet(folder).groupBy("job_id").agg(F.max_by("event", F.when(F.col("event") != "checkpoint", F.col("seq"))).alias("status"), F.count(F.lit(1)).alias("events"))
    assert got == {(r.job_id, r.status, r.events) for r in batch.collect()}


def test_windows_and_sessions_emit(spark, folder):
    assert run(spark, folder, stream_jobs.hourly_events, "append", "hourly").count() > 0
    assert run(spark, folder, stream_jobs.idle_sessions, "append", "idle").count() > 0


STATE = ("job_id", "status", "error", "result", "checkpoint", "created_at", "updated_at")


def states(df):
    return sorted(tuple(r[c] for c in STATE) for r in df.select(*STATE).collect())


@pytest.mark.parametrize("files", [1, 2])
def test_store_in_pieces_equals_batch_state(spark, tmp_path, files):
    """Each file holds events of all jobs, out of order, and the store keeps no more than the latest state."""
    log = fixtures.job_log(spark, DATA)
    for k, seed in enumerate((5, 1, 9)):
        log.where((log.seq * 7 + log.job_id * 3) % 3 == k).orderBy(F.rand(seed)).coalesce(1).write.parquet(f"{tmp_path}/log/part{k}")
    folder = f"{tmp_path}/flat"
    spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log").repartition(3).write.parquet(folder)
    rows = store.replayed(spark, folder, guarded=False, files=files)
    assert states(store.latest(rows)) == states(jobs.job_state(log))
    assert rows.agg(F.max("batch")).first()[0] >= 1


LOG = "job_id long, seq long, at timestamp, event string, error string, result double, checkpoint long"


def written(spark, path, *batches):
    at = datetime(2024, 1, 1)
    for k, events in enumerate(batches):
        rows = [(j, seq, at + timedelta(days=day), e, more.get("error"), more.get("result"), more.get("checkpoint")) for j, seq, day, e, more in events]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    return path


def test_refused_runs_and_cleared_errors(spark, tmp_path):
    """A run of an unknown or cancelled job is refused and changes nothing; a status without an error clears it; results stay."""
    folder = written(
        spark, f"{tmp_path}/log",
        [(1, 1, 0, "running", {}), (2, 2, 0, "created", {}), (2, 3, 0, "running", {}), (2, 4, 0, "failed", {"error": "broken"}), (3, 5, 0, "created", {}), (3, 6, 0, "cancelled", {})],
        [(2, 7, 1, "running", {}), (2, 8, 1, "checkpoint", {"checkpoint": 4}), (3, 9, 1, "running", {}), (4, 10, 1, "created", {}), (4, 11, 1, "completed", {"result": 2.5}), (4, 12, 1, "running", {}), (5, 13, 1, "created", {}), (5, 14, 1, "deleted", {}), (5, 15, 1, "running", {})],
    )
    rows = store.replayed(spark, folder)
    refused = {(r.job_id, r.seq, r.reason) for r in rows.where("kind = 'refused'").collect()}
    assert refused == {(1, 1, store.UNKNOWN), (3, 9, store.CANCELLED), (5, 15, store.UNKNOWN)}
    left = {r.job_id: (r.status, r.error, r.result, r.checkpoint) for r in store.latest(rows).collect()}
    assert left == {2: ("running", None, None, 4), 3: ("cancelled", None, None, None), 4: ("running", None, 2.5, None)}


def test_jobs_expire_by_event_time(spark, tmp_path):
    """A job goes once events are more than its days later, unless it had another event; whatever its status."""
    folder = written(
        spark, f"{tmp_path}/log", [(1, 1, 0, "created", {}), (2, 2, 0, "created", {}), (3, 3, 2, "created", {})], [(2, 4, 6, "completed", {"result": 1.0}), (3, 5, 6.5, "running", {})], [(4, 6, 9, "created", {})], [(4, 7, 9.1, "running", {})],
    )
    rows = store.replayed(spark, folder, days=7)
    assert {r.job_id for r in rows.where("kind = 'expired'").collect()} == {1}
    assert {r.job_id: r.status for r in store.latest(rows).collect()} == {2: "completed", 3: "running", 4: "running"}


def test_folding_events_in_any_order_is_the_same():
    rng, kinds = random.Random(3), ["created", "pending", "running", "checkpoint", "completed", "failed", "cancelled"]
    for _ in range(50):
        events = [{"seq": i, "us": rng.randrange(60), "event": (k := rng.choice(kinds)), "error": "x" if k == "failed" else None, "result": 1.0 if k == "completed" else None, "checkpoint": i if k == "checkpoint" else None} for i in range(8)]
        ends = []
        for _ in range(3):
            job = None
            for e in events:
                job = store.applied(job, e)
            ends.append(job)
            rng.shuffle(events)
        assert ends[0] == ends[1] == ends[2]
