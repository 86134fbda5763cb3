"""Exports: zero-based nodes with page spans, nested JSON, archive manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import FULL_PAGE, box
from ..functions.text import safe_stem

VERSION = "foliant-1"
#: Fixed value: why a page has failed.
PAGE_FAILED = "Page processing failed"


def export_nodes(ranged: DataFrame, failed_pages: DataFrame | None = None) -> DataFrame:
    """Flat nodes with zero-based ids by type: blocks, and pages spanning from their first to their last block.

    Input: ranged blocks with ``box`` (null: the full page). ``failed_pages``: ``doc_id, page`` of pages that failed."""
    number = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("seq")) - 1
    blocks = ranged.select("doc_id", "page_seq", "page", "seq", "type", F.concat("type", F.lit("-"), number.cast("string")).alias("node_id"), "start", "end", F.coalesce("box", box(*FULL_PAGE)).alias("box"), F.lit("ok").alias("status"))
    span = ranged.groupBy("doc_id", "page_seq", "page").agg(F.coalesce(F.min("start"), F.lit(0)).alias("start"), F.coalesce(F.max("end"), F.lit(0)).alias("end"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_seq")) - 1
    pages = span.select("doc_id", "page_seq", "page", F.lit(0).alias("seq"), F.lit("page").alias("type"), F.concat(F.lit("page-"), number.cast("string")).alias("node_id"), "start", "end", box(*FULL_PAGE).alias("box"), F.lit("ok").alias("status"))
    if failed_pages is not None:
        bad = failed_pages.select("doc_id", "page", F.lit(True).alias("failed")).distinct()
        pages = pages.join(bad, ["doc_id", "page"], "left").withColumn("status", F.when(F.col("failed"), "failed").otherwise("ok")).drop("failed").select(*blocks.columns)
    return blocks.unionByName(pages)


_CELLS = {"row": "int", "col": "int", "rowspan": "int", "colspan": "int"}
_ATOMIC = "array<struct<start:bigint,end:bigint,box:struct<left:double,top:double,right:double,bottom:double>>>"
_META = {"job_id": "string", "source_page_count": "bigint", "failed_pages": "array<int>", "duration_ms": "bigint", "service_tier": "string", "total_credits": "double"}
_WRAP = {"engine": "string", "warnings": "array<string>"}


def _with_defaults(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with the columns that it lacks, null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def _corners(b: Column) -> Column:
    return F.struct(b["left"].alias("xmin"), b["top"].alias("ymin"), b["right"].alias("xmax"), b["bottom"].alias("ymax"))


def _grounding(page: Column, start: Column, end: Column, b: Column) -> Column:
    return F.struct(page.alias("page"), F.struct(start.alias("start"), end.alias("end")).alias("range"), _corners(b).alias("box"))


def _in_order(order: str, item: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), item.alias("item")))), lambda x: x["item"])


def _ade(nodes: DataFrame, texts: DataFrame, metadata: DataFrame | None, version: str) -> DataFrame:
    """``doc_id`` and ``ade``, the exported document as a struct."""
    n = _with_defaults(nodes, {**_CELLS, "atomic": _ATOMIC, "parent_id": "string", "reason": "string"})
    lines = F.transform("atomic", lambda a: _grounding(F.col("page"), a["start"], a["end"], a["box"]))
    empty = F.slice(F.array(_grounding(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), box(*FULL_PAGE))), 1, 0)
    atomic = F.when(F.col("type") == "table_cell", F.coalesce(lines, empty)).when((F.col("type") != "table") & (F.size("atomic") > 0), lines)
    own = [F.col("node_id").alias("id"), "type", _grounding(F.col("page"), F.col("start"), F.col("end"), F.col("box")).alias("grounding"), atomic.alias("atomic_grounding"), *_CELLS]
    cells = n.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(_in_order("seq", F.struct(*own)).alias("cells"))
    blocks = n.where("parent_id is null and type <> 'page'").join(cells, ["doc_id", "node_id"], "left")
    leaves = blocks.groupBy("doc_id", "page_seq").agg(_in_order("seq", F.struct(*own, F.coalesce("cells", F.slice(F.array(F.struct(*own)), 1, 0)).alias("children"))).alias("children"))
    pages = n.where("type = 'page'").join(leaves, ["doc_id", "page_seq"], "left")
    page = F.struct(F.col("node_id").alias("id"), "type", _grounding(F.col("page"), F.col("start"), F.col("end"), F.col("box")).alias("grounding"), "status", F.when(F.col("status") == "failed", PAGE_FAILED).alias("reason"), "children")
    tree = pages.groupBy("doc_id").agg(_in_order("page_seq", page).alias("children"), F.count(F.lit(1)).alias("page_count")).join(texts, "doc_id")
    tree = _with_defaults(tree if metadata is None else tree.join(metadata, "doc_id", "left"), _META)
    meta = F.struct(
        "job_id", F.lit(version).alias("model_version"), F.coalesce("source_page_count", "page_count").alias("page_count"), F.length("markdown").alias("output_markdown_chars"),
        F.coalesce("failed_pages", F.array().cast("array<int>")).alias("failed_pages"), "duration_ms", F.struct(F.coalesce("service_tier", F.lit("local")).alias("service_tier"), "total_credits").alias("billing"),
    )
    root = F.struct(F.lit("document-0").alias("id"), F.lit("document").alias("type"), "children")
    return tree.select("doc_id", F.struct("markdown", meta.alias("metadata"), root.alias("structure")).alias("ade"))


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def export_json(nodes: DataFrame, texts: DataFrame, metadata: DataFrame | None = None, version: str = VERSION) -> DataFrame:
    """``doc_id`` and ``json``: Markdown, metadata and the node tree of each document (K1).

    ``nodes``: those of ``export_nodes``, with ``atomic`` (array of ``start, end, box``), ``row, col, rowspan, colspan`` and, for cells, ``parent_id``, the node id of their table, where there are any. Tables
    have no atomic grounding, cells an array even if it is empty, others one or null. ``metadata``: ``doc_id`` and any of ``job_id, source_page_count, failed_pages,
    duration_ms, service_tier, total_credits``; the source's page count comes before the number of pages."""
    return _ade(nodes, texts, metadata, version).select("doc_id", _json(F.col("ade")).alias("json"))


def wrapped_export(nodes: DataFrame, texts: DataFrame, words: DataFrame, relations: DataFrame, usage: DataFrame, metadata: DataFrame | None = None, version: str = VERSION) -> DataFrame:
    """The export with engine, words, relations, warnings and usage of each document around it (K2).

    ``words``: ``doc_id, seq, text, page, start, end, box, confidence``; ``relations``: ``doc_id, kind`` and whatever else they say, as of ``relations.all_relations``; ``usage``: ``doc_id,
    model_id`` and token counts; ``metadata`` may also have ``engine`` and ``warnings``. What a document lacks is an empty list or map."""
    word = F.struct("text", _grounding(F.col("page"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("box")).alias("grounding"), "confidence")
    said = F.struct(*[c for c in relations.columns if c != "doc_id"])
    counts = F.struct(*[c for c in usage.columns if c not in ("doc_id", "model_id")])
    w = words.groupBy("doc_id").agg(_in_order("seq", word).alias("words"))
    r = relations.groupBy("doc_id").agg(F.array_sort(F.collect_list(said)).alias("relations"))
    u = usage.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_id", counts)))).alias("model_usage"))
    out = _ade(nodes, texts, metadata, version)
    for part in (w, r, u):
        out = out.join(part, "doc_id", "left")
    out = _with_defaults(out if metadata is None else out.join(_with_defaults(metadata, _WRAP).select("doc_id", *_WRAP), "doc_id", "left"), _WRAP)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    usage_ = F.coalesce("model_usage", F.create_map().cast(out.schema["model_usage"].dataType))
    whole = F.struct("ade", "engine", F.create_map().cast("map<string,string>").alias("provenance"), empty("words").alias("words"), empty("relations").alias("relations"), empty("warnings").alias("warnings"), usage_.alias("model_usage"))
    return out.select("doc_id", _json(whole).alias("json"))


def content_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes in pre-order without pages."""
    return nodes.where("type not in ('page', 'document')").orderBy("doc_id", "seq")


PAYLOADS = (("markdown", "md"), ("html", "html"), ("annotated_pdf", "annotated.pdf"), ("export_json", "export.json"), ("ade_json", "ade-v2.json"))


def archive_manifest(entries: DataFrame, payloads: tuple = PAYLOADS, keep: Sequence[str] = ()) -> DataFrame:
    """Manifest rows: numbered folder of each entry, and the files in it. Only completed entries list files; null payloads are left
    out. ``entries``: ``seq, filename, status`` and the payload columns; those of ``keep`` stay. Ordering is by ``seq``, which callers number from 1,
    so no global window is needed."""
    stem = safe_stem(F.col("filename"))
    folder = F.concat(F.format_string("%02d-", F.col("seq").cast("int")), stem)
    files = F.array(*[F.when(F.col(c).isNotNull(), F.concat(folder, F.lit("/"), stem, F.lit(f".{ext}"))) for c, ext in payloads if c in entries.columns])
    files = F.when(F.col("status") == "completed", F.array_compact(files)).otherwise(F.array().cast("array<string>"))
    return entries.select(*keep, "seq", folder.alias("folder"), "filename", "status", files.alias("files"))


#: Fixed value: what is said of a document that failed without a reason.
FAILED = "Parsing failed"


def archive_entries(outcomes: DataFrame, exports: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Entries of a job's archive (K12): ``seq, filename, status, error`` and the payloads of ``archive_manifest``. A failed document has its error only; of the others, an artifact
    that couldn't be made is null, with its own error.

    ``outcomes``: ``file_id, seq, filename, status, error``; ``exports``: ``file_id, markdown, html, export_json, ade_json``; ``artifacts``: ``file_id, annotated_pdf, artifact_error``."""
    met = outcomes.join(exports, "file_id", "left").join(artifacts, "file_id", "left")
    done = F.col("status") == "completed"
    error = F.when(done, F.col("artifact_error")).otherwise(F.coalesce("error", F.lit(FAILED)))
    return met.select("seq", "filename", "status", error.alias("error"), *[F.when(done, F.col(c)).alias(c) for c, _ in PAYLOADS])


def annotation_counts(nodes: DataFrame) -> DataFrame:
    """Blocks that can be drawn on a page of the source, and those that can't (K7). ``nodes`` has ``box, page, source_page_count``."""
    drawn = F.col("box").isNotNull() & F.col("page").isNotNull() & (F.col("page") <= F.col("source_page_count"))
    return nodes.groupBy("doc_id").agg(F.count_if(drawn).alias("annotated"), F.count_if(~F.coalesce(drawn, F.lit(False))).alias("semantic"))


def draw_list(nodes: DataFrame) -> DataFrame:
    """Rectangles in page units (K7). ``nodes`` has ``box, page, width, height``."""
    return nodes.where("box is not null and page is not null").select("doc_id", "page", *[(F.col(f"box.{s}") * F.col(d)).alias(s) for s, d in (("left", "width"), ("top", "height"), ("right", "width"), ("bottom", "height"))])
