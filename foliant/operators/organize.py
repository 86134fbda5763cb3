"""Cited organisation of pages: classify, split, section (Q1 to Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold
from .assemble import PAGE_GAP

NO_MATCH = "No deterministic keyword match; returned the first allowed class"


def page_texts(ranged: DataFrame) -> DataFrame:
    """``doc_id, page_seq, page, text, start, end`` of pages: what lies between their first and last block."""
    g = ranged.groupBy("doc_id", "page_seq", "page").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("ord", "markdown"))).alias("b"))
    return g.withColumn("text", F.array_join(F.transform("b", lambda x: x["markdown"]), "\n\n")).drop("b")


def class_terms(names: list[tuple[str, str]]) -> list[list[str]]:
    """Terms of each class, sorted: words of its name and description of more than three letters."""
    import re

    return [sorted({w for w in re.findall(r"[a-z0-9]+", f"{n} {d}".casefold()) if len(w) > 3}) for n, d in names]


def classify(pages: DataFrame, classes: list[tuple[str, str]]) -> DataFrame:
    """Pages with ``label`` and ``reason``: the first class of which a term stands in the text, else the first class.

    Classes are few and are the caller's, so they become one expression: no join, no shuffle."""
    if not classes:
        raise ValueError("At least one class is required")
    folded = casefold(F.col("text"))
    label, reason = F.lit(classes[0][0]), F.lit(NO_MATCH)
    for (name, _), terms in reversed(list(zip(classes, class_terms(classes), strict=True))):
        hit = F.coalesce(*[F.when(folded.contains(t), F.lit(t)) for t in terms], F.lit(None).cast("string"))
        label = F.when(hit.isNotNull(), F.lit(name)).otherwise(label)
        reason = F.when(hit.isNotNull(), F.concat(F.lit("Matched source term: "), hit)).otherwise(reason)
    return pages.withColumns({"label": label, "reason": reason})


def split(classified: DataFrame) -> DataFrame:
    """Pages of each label together, labels in order of first appearance."""
    g = classified.groupBy("doc_id", "label").agg(F.min("page_seq").alias("first"), F.array_sort(F.collect_list(F.struct("page_seq", "page", "text", "start", "end"))).alias("p"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return g.select("doc_id", rank.alias("position"), "label", F.transform("p", lambda x: x["page"]).alias("pages"), F.array_join(F.transform("p", lambda x: x["text"]), PAGE_GAP).alias("markdown"), F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("ranges"))


def sections(ranged: DataFrame) -> DataFrame:
    """One section for each page with blocks: title from its first block, a warning where that is no heading."""
    first = ranged.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "page_seq").orderBy("ord"))).where("rn = 1")
    line = F.trim(F.substring_index("markdown", "\n", 1))
    title = F.substring(F.coalesce(F.nullif(line, F.lit("")), F.lit("Untitled section")), 1, 160)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_seq"))
    partial = ~F.coalesce(F.col("semantic_role").isin("title", "heading"), F.lit(False))
    return first.select("doc_id", "page", number.alias("section_number"), title.alias("title"), F.col("id").alias("start_reference"), "start", "end", partial.alias("partial"))


def section_warnings(sections_: DataFrame) -> DataFrame:
    """A line for each section that begins without a heading (Q3)."""
    line = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": no explicit heading; first grounded block used as a partial"))
    return sections_.where("partial").select("doc_id", "page", line.alias("warning"))
