"""The driver's tables seen as the relations that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns as blocks: document ``conv_id``, page ``turn + 1``, system turns as marginalia, first lines as headings."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null and text is not null")
    lines = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "role", F.posexplode(F.split("text", "\n")).alias("i", "markdown"))
    return lines.select("doc_id", F.col("page").alias("page_seq"), "page", (F.col("i") + 1).alias("ord"), F.when(F.col("role") == "system", "marginalia").otherwise("text").alias("type"), F.when(F.col("i") == 0, "heading").alias("semantic_role"), "markdown")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("ord"), "line")


def embedding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from the first four numbers of each vector; the page is the label."""
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    left, top = F.least(F.abs(e[0]), F.lit(0.5)), F.least(F.abs(e[1]), F.lit(0.5))
    right, bottom = left + 0.1 + F.least(F.abs(e[2]), F.lit(0.4)), top + 0.1 + F.least(F.abs(e[3]), F.lit(0.4))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("page"), F.col("vec_id").alias("seq"), box(left, top, right, bottom).alias("box"))


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("model-"), (F.col("l_suppkey") % 4).cast("string")).alias("model_id"), F.floor("l_extendedprice").cast("long").alias("input_tokens"), F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("long").alias("cached_input_tokens"), (F.col("l_quantity") * 10).cast("long").alias("output_tokens"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log: ten consecutive events make a job."""
    kinds = {"signup": "pending", "view": "running", "click": "checkpoint", "purchase": "completed", "error": "failed"}
    event = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()])
    ev = table(spark, sf_dir, "events").withColumn("event", event)
    return ev.select(F.expr("event_id div 10").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), "event", F.when(F.col("event") == "failed", F.col("props")).alias("error"), F.when(F.col("event") == "completed", F.col("value")).alias("result"), F.when(F.col("event") == "checkpoint", F.col("event_id")).alias("checkpoint"))
