"""Helpers that the training-data operators share: tables, shared storage, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []
_written: list[str] = []

#: Key of a document without an id, where only one has none.
NO_ID = (1 << 63) - 1
#: Bytes of text that a Python worker expands into arrays at one time.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch that holds texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and
    there is no cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="foliant-"))
    return _own_dir[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, and any executor can be lost afterwards.

    ``discard`` removes such a table once nothing reads it any more; ``clean_up`` removes all that this process wrote."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that no later step, nor a result that is still to be computed, reads."""
    for t in tables:
        if getattr(t, "_foliant_path", None) in _written:
            _remove(t.sparkSession, t._foliant_path)


def clean_up(spark: SparkSession) -> None:
    """Remove all materialised tables of this process: for callers whose results are written or collected."""
    for path in list(_written):
        _remove(spark, path)


def unused(columns: Iterable[str]) -> Callable[[str], str]:
    """Names for helper columns: each name asked for, with underscores before it until it clashes with none of ``columns`` (Spark's names don't tell cases apart)."""
    taken = {c.lower() for c in columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name = f"_{name}"
        return name

    return free


def with_keys(docs: DataFrame, id_col: str, text_col: str, key: str) -> tuple[DataFrame, bool]:
    """``docs`` with a number in the column ``key`` that orders documents by id, null last, and whether numbers may repeat.

    Where all ids differ and at most one is null, the id is the key. Else documents are numbered in the order of id and text hash; rows of one
    id and one text (null like empty) share a number. Numbers are written down, so that a lost executor can't change them. Columns of ``docs``
    may have any names but ``key``."""
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    if docs.groupBy(number.alias("d")).count().where("count > 1").isEmpty():
        return docs.withColumn(key, number), False
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    free = unused(docs.columns)
    named = {free("none"): F.col(id_col).isNull(), free("id"): number, free("text"): text}
    rows = docs.withColumns(named)
    ordered = rows.select(*named).distinct().repartitionByRange(*named).sortWithinPartitions(*named)
    numbered = materialise(ordered.withColumn(key, F.monotonically_increasing_id()), "keys")
    return rows.join(numbered, list(named)).select(*docs.columns, key), True


def dealt_in_order(rows: DataFrame, order: list[Column], within: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` dealt by ranges of ``order`` (which begins with ``within``), sorted there, and written with a running number ``at`` and ``part``; and a small table, one row for each
    group and partition that meet: ``of_...`` (the group), ``of_part``, ``first`` (the least number), ``before`` (rows of the group in partitions before) and ``total``.

    So no group is sorted in one task, and nothing but that table grows with groups and partitions."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt, name).withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy(*within, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    sums = counts.withColumns({"before": F.sum("n").over(w.orderBy("part")) - F.col("n"), "total": F.sum("n").over(w)})
    return dealt, materialise(sums.select(*[F.col(c).alias(f"of_{c}") for c in within], F.col("part").alias("of_part"), "first", "before", "total"), f"{name}-parts")


def with_positions(dealt: DataFrame, parts: DataFrame, within: list[str]) -> DataFrame:
    """The rows with ``position``, from 0 within their group, ``total``, and what else the small table holds."""
    same = F.col("part") == F.col("of_part")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    more = [c for c in parts.columns if c not in ("of_part", "first", "before", *(f"of_{w}" for w in within))]
    return dealt.join(parts, same).select(*[c for c in dealt.columns if c not in ("at", "part")], (F.col("at") - F.col("first") + F.col("before")).alias("position"), *more)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand rows to Python workers in Arrow batches of at most ``rows``, for the rest of the session: JVM and worker hold a batch of texts, or of
    pairs of shingle sets, as a whole. A smaller setting stays."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def sliced(sizes, limit: int = SLICE_BYTES):
    """Yield ``(start, end)`` runs of rows of at most ``limit`` bytes together; a larger row stands alone."""
    sizes, start, total = list(sizes), 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)
