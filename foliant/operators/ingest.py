"""Rows that extraction systems and models deliver, made into blocks and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normalize_points, parse_model_box
from ..functions.text import split_lines, visual_placeholder


def layout_blocks(items: DataFrame) -> DataFrame:
    """Blocks from layout items: ``kind`` (table, picture or other), ``label, markdown, description, caption, box`` in page units
    with ``width`` and ``height``, origin at the bottom left (S11, S13, S26). Items without content go."""
    box = normalize_points(F.col("box"), F.col("width"), F.col("height"), bottom_left=True)
    picture = F.col("kind") == "picture"
    caption = F.nullif(F.trim(F.coalesce("caption", F.lit(""))), F.lit(""))
    plain = F.when(caption.isNotNull(), F.regexp_replace(visual_placeholder(F.lit("FIGURE")), "</figure>$", "")).otherwise(visual_placeholder(F.lit("FIGURE")))
    fallback = F.when(caption.isNotNull(), F.concat(plain, F.lit("\n"), caption, F.lit("</figure>"))).otherwise(plain)
    markdown = F.when(picture, F.coalesce("description", fallback)).otherwise(F.trim(F.coalesce("markdown", F.lit(""))))
    out = items.withColumns({"block_box": box, "block_markdown": markdown}).where("block_markdown <> ''")
    lines = F.when(F.col("block_box").isNotNull() & (F.col("kind") != "table"), split_lines(F.col("block_markdown"))).otherwise(F.array().cast("array<string>"))
    keep = [c for c in items.columns if c not in ("kind", "label", "markdown", "description", "caption", "box", "width", "height")]
    return out.select(
        *keep, F.when(F.col("kind") == "table", "table").when(picture, "figure").otherwise("text").alias("type"), F.col("block_markdown").alias("markdown"), F.col("label").alias("semantic_role"),
        F.col("block_box").alias("box"), F.when(F.col("block_box").isNotNull(), "grounded").otherwise("semantic_only").alias("grounding_status"), lines.alias("lines"),
    )


def cell_markdown(text: Column) -> Column:
    """Text of a table cell, escaped but for quotes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Warnings of the page inspector and of figures without a description.
ENCODING_WARNING, FIGURE_WARNING = "PDF Inspector reported broken text encoding; selected pages may need OCR.", "figure description unavailable"


def table_cells(items: DataFrame) -> DataFrame:
    """Cells of layout tables: escaped text, place and spans (S14). ``items``: keys and ``cells``, an array of ``text, row, col, rowspan, colspan``; cells without text are left out."""
    cell = F.col("c")
    keep = [F.col(c) for c in items.columns if c != "cells"]
    out = items.select(*keep, F.posexplode("cells").alias("ord", "c")).where(F.trim(F.coalesce(cell["text"], F.lit(""))) != "")
    return out.select(*keep, "ord", cell_markdown(cell["text"]).alias("markdown"), F.coalesce(cell["row"], F.lit(0)).alias("row"), F.coalesce(cell["col"], F.lit(0)).alias("col"), F.coalesce(cell["rowspan"], F.lit(1)).alias("rowspan"), F.coalesce(cell["colspan"], F.lit(1)).alias("colspan"))


def union_boxes(items: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``box``, around the boxes of all items; null where none has one."""
    sides = items.groupBy(*keys).agg(F.min("box.left").alias("left"), F.min("box.top").alias("top"), F.max("box.right").alias("right"), F.max("box.bottom").alias("bottom"))
    return sides.select(*keys, F.when(F.col("left").isNotNull(), F.struct("left", "top", "right", "bottom")).alias("box"))


def page_markdown_blocks(pages: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """One block for each page with text, around all its positioned items (S16, S27). ``items``: ``box`` in shares of the page."""
    met = pages.where(F.trim(F.coalesce("markdown", F.lit(""))) != "").join(union_boxes(items, keys), keys, "left")
    return met.select(*keys, F.trim("markdown").alias("markdown"), "box", F.when(F.col("box").isNotNull(), "grounded").otherwise("semantic_only").alias("grounding_status"))


def source_warnings(documents: DataFrame, figures: DataFrame) -> DataFrame:
    """``doc_id, warning``, each once for a document: broken encoding (``documents``: ``broken_encoding``), figures without a description."""
    broken = documents.where("broken_encoding").select("doc_id", F.lit(ENCODING_WARNING).alias("warning"))
    bare = figures.where(F.coalesce(F.trim("description"), F.lit("")) == "").select("doc_id", F.lit(FIGURE_WARNING).alias("warning"))
    return broken.unionByName(bare).distinct()


def atomic_lines(lines: Column) -> Column:
    """Lines of a model's chunk that have text and a usable box."""
    parsed = F.transform(F.coalesce(lines, F.array().cast("array<struct<text:string,box:struct<left:double,top:double,right:double,bottom:double>>>")), lambda x: F.struct(x["text"].alias("text"), parse_model_box(x["box"]).alias("box")))
    return F.filter(parsed, lambda x: (F.trim(F.coalesce(x["text"], F.lit(""))) != "") & x["box"].isNotNull())


def normalized_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with what a model left out: Markdown from the text, boxes from thousandths."""
    return chunks.withColumns({"markdown": F.coalesce("markdown", "text", F.lit("")), "box": F.coalesce(parse_model_box(F.col("box")), F.col("box"))})


def geometry_error(boxes: Column, path: str = "$.chunks") -> Column:
    """Message on the first reversed or empty box of an array, with its path, or null."""
    bad = F.transform(boxes, lambda b, i: F.when((b["left"] >= b["right"]) | (b["top"] >= b["bottom"]), F.format_string(f"{path}[%d].box must have left < right and top < bottom", i)))
    return F.get(F.array_compact(bad), F.lit(0))


def block_count(nodes: DataFrame) -> DataFrame:
    """Blocks of each document, at any depth."""
    return nodes.groupBy("doc_id").agg(F.count_if(~F.col("type").isin("page", "document")).alias("blocks"))


def block_violation(b: Column) -> Column:
    """The first rule of block input that a block breaks, or null (V8). ``b``: ``type, grounding_status, box, row, col, n_cells``."""
    cell = b["type"] == "table_cell"
    return (
        F.when((b["grounding_status"] == "grounded") & b["box"].isNull(), "grounded block input requires a normalized box")
        .when((b["grounding_status"] == "semantic_only") & b["box"].isNotNull(), "semantic-only block input cannot claim a normalized box")
        .when(cell & (b["row"].isNull() | b["col"].isNull()), "table cell input requires row and col").when(cell & (b["n_cells"] > 0), "table cell input cannot contain table cells")
        .when(~cell & (b["row"].isNotNull() | b["col"].isNotNull()), "only table cell input accepts row and col").when((b["type"] != "table") & (b["n_cells"] > 0), "only table input can contain table cells")
    )


def chunk_violation(chunk_id: Column, status: Column, n_grounding: Column) -> Column:
    """What is wrong with a chunk's id or evidence, or null (V9)."""
    return F.when(~F.coalesce(chunk_id.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"), F.lit(False)), "malformed id").when((status == "verified") & (F.coalesce(n_grounding, F.lit(0)) == 0), "verified chunk requires grounding evidence")
