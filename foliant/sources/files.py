"""Files as rows, and results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape of a model's page draft, of a crop verdict and of a figure description.
DRAFT = "array<struct<order:int,type:string,text:string,markdown:string,box:struct<left:double,top:double,right:double,bottom:double>,parent_order:int,row:int,col:int>>"
VERDICT = "struct<text:string,markdown:string,box:struct<left:double,top:double,right:double,bottom:double>,verdict:string,reason:string>"
FIGURE = "struct<type:string,description:string,visible_text:string>"


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, filename, size, modified, content`` of files below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def hashes(found: DataFrame) -> DataFrame:
    """SHA-256 of each file."""
    return found.select("path", "size", F.sha2("content", 256).alias("sha256"))


def drafts(raw: DataFrame, column: str = "json") -> DataFrame:
    """Chunks of page drafts from JSON text; what doesn't fit the shape is null and is left out."""
    return raw.withColumn("chunk", F.explode(F.from_json(column, DRAFT))).where("chunk.type is not null").select(*[c for c in raw.columns if c != column], "chunk.*")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet by keys, rows of a key brought together first, so that no task writes to every folder."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
