"""Relations inferred across the pages of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import relation_key


def repeated_marginalia(blocks: DataFrame) -> DataFrame:
    """Marginal blocks whose text stands more than once in their document."""
    keyed = blocks.where("type = 'marginalia'").withColumn("key", relation_key(F.col("markdown"))).where("key <> ''")
    return keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "key"))).where("n > 1").select("doc_id", "page", F.col("id").alias("block_id"), "n")


def section_starts(blocks: DataFrame) -> DataFrame:
    """Title and heading blocks with their first line; an empty block has a null title."""
    title = F.nullif(F.substring_index("markdown", "\n", 1), F.lit(""))
    return blocks.where("semantic_role in ('title', 'heading')").select("doc_id", "page", F.col("id").alias("block_id"), title.alias("title"))


def continued_tables(tables: DataFrame) -> DataFrame:
    """Last table of a page and first of the next that have as many columns.

    ``tables``: ``doc_id, page_seq, ord, id, columns``; pages without tables must be there with null ``id`` if they separate
    others, so ``page_seq`` is compared: only neighbours in the selection continue each other."""
    page = Window.partitionBy("doc_id", "page_seq").orderBy("ord")
    back = Window.partitionBy("doc_id", "page_seq").orderBy(F.col("ord").desc())
    ends = tables.where("id is not null").withColumns({"a": F.row_number().over(page), "z": F.row_number().over(back)}).where("a = 1 or z = 1")
    per = ends.groupBy("doc_id", "page_seq").agg(F.max_by("id", F.col("z") == 1).alias("last_id"), F.max_by("columns", F.col("z") == 1).alias("last_columns"), F.max_by("id", F.col("a") == 1).alias("first_id"), F.max_by("columns", F.col("a") == 1).alias("first_columns"))
    w = Window.partitionBy("doc_id").orderBy("page_seq")
    nxt = per.withColumns({n: F.lead(c).over(w) for n, c in (("to_page", "page_seq"), ("to_id", "first_id"), ("to_columns", "first_columns"))})
    return nxt.where("to_page = page_seq + 1 and last_columns > 0 and last_columns = to_columns").select("doc_id", F.col("page_seq").alias("from_page"), "to_page", F.col("last_id").alias("from_id"), "to_id", F.col("last_columns").alias("column_count"))


def selection_boundaries(docs: DataFrame) -> DataFrame:
    """Documents of which only some pages were selected: ``doc_id, first_page, last_page, source_page_count``."""
    warning = F.lit("Pages outside the selected range were not inspected.")
    return docs.where("first_page > 1 or last_page < source_page_count").select("doc_id", "first_page", "last_page", warning.alias("warning"))


def all_relations(blocks: DataFrame, tables: DataFrame, docs: DataFrame) -> DataFrame:
    """All four kinds as one table."""
    parts = [
        section_starts(blocks).withColumn("kind", F.lit("section_start")),
        repeated_marginalia(blocks).drop("n").withColumn("kind", F.lit("repeated_marginalia")),
        continued_tables(tables).withColumn("kind", F.lit("continued_table")),
        selection_boundaries(docs).withColumn("kind", F.lit("selection_boundary")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
