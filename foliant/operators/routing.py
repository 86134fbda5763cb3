"""Which pages go to a model, in what context, and what labels and engines become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REFINE_BELOW, CONTEXT, CONTEXT_GAP = 0.80, 6000, "\n\n"
#: Chunk types as block type and role.
BLOCK_TYPES = {"title": ("text", "title"), "heading": ("text", "heading"), "text": ("text", None), "list": ("text", "list"), "checkbox": ("text", "checkbox"), "table": ("table", None), "table_cell": ("text", "table_cell"), "form_field": ("text", "form_field"), "figure": ("figure", None), "chart": ("figure", "chart"), "header": ("marginalia", "header"), "footer": ("marginalia", "footer")}
#: Chunk types of layout labels, by the whole label or by what it contains, the first that fits; text for all others.
LABEL_TYPES = (
    ("is", "doc_title", "title"), ("is", "paragraph_title", "heading"), ("is", "section_title", "heading"), ("contains", "table", "table"), ("is", "chart", "chart"),
    ("is", "image", "figure"), ("is", "seal", "figure"), ("contains", "header", "header"), ("is", "footer", "footer"), ("is", "page_number", "footer"),
)
#: Labels of visual regions, and the prompts of each model family by kind of region.
FIGURES = ("chart", "image", "seal")
PROMPTS = {
    "glmocr": {"table": "Table Recognition:", "formula": "Formula Recognition:", "figure": "Figure Recognition:", "text": "Text Recognition:"},
    "deepseekocr": {"table": "<|grounding|>Convert the document to markdown.", "formula": "<|grounding|>Convert the document to markdown.", "figure": "Parse the figure.", "text": "Free OCR."},
    "paddleocr": {"table": "OCR:", "formula": "OCR:", "figure": "OCR:", "text": "OCR:"},
}


def needs_model(strategy: Column, confidence: Column, empty: Column, flagged: Column) -> Column:
    """Whether a page is refined by a model, by the document's strategy (Q6)."""
    low = confidence.isNull() | (confidence < REFINE_BELOW)
    return F.when(strategy == "docling_ai", low | empty).when(strategy == "pdf_inspector_ai", low | flagged | empty).otherwise(strategy.isin("ai", "ollama"))


def with_context(pages: DataFrame, size: int = CONTEXT) -> DataFrame:
    """Pages with ``before``, the last ``size`` characters of the pages before them in their document.

    Pages lie on a line by where the next one begins; a range frame over that takes only those that reach into the last ``size``
    characters, so a page costs as much as its context, wherever it stands."""
    by_page = Window.partitionBy("doc_id").orderBy("page_seq")
    placed = pages.withColumn("_next", F.sum(F.length("text") + len(CONTEXT_GAP)).over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy("doc_id").orderBy("_next").rangeBetween(-size - len(CONTEXT_GAP), 0)
    text = F.array_join(F.collect_list(F.right("text", F.lit(size))).over(near), CONTEXT_GAP)
    said = placed.withColumn("_text", F.right(text, F.lit(size)))
    return said.withColumn("before", F.coalesce(F.lag("_text").over(by_page), F.lit(""))).drop("_next", "_text")


def block_type(kind: Column) -> Column:
    out = F.lit(None).cast("struct<type:string,role:string>")
    for k, (t, r) in BLOCK_TYPES.items():
        out = F.when(kind == k, F.struct(F.lit(t).alias("type"), F.lit(r).cast("string").alias("role"))).otherwise(out)
    return out


def engine_label(parsers: Column) -> Column:
    """The parser of all pages, or hybrid (N26). ``parsers``: array of distinct names."""
    return F.when(F.size(parsers) > 1, "hybrid").otherwise(F.element_at(parsers, 1))


def strategy_for(docling: Column, inspector: Column, ai: Column, local: Column) -> Column:
    """Strategy from toggles; at most one local parser, and a local model stands alone."""
    n = lambda *cs: sum((c.cast("int") for c in cs[1:]), cs[0].cast("int"))
    return (
        F.when(n(docling, inspector) > 1, "error: one local parser at most").when(local & (docling | inspector | ai), "error: a local model stands alone")
        .when(local, "ollama").when(docling & ai, "docling_ai").when(inspector & ai, "pdf_inspector_ai").when(docling, "docling").when(inspector, "pdf_inspector").when(ai, "ai").otherwise("error: no engine")
    )


def chunk_type(label: Column) -> Column:
    """Chunk type of a layout label."""
    v = F.lower(label)
    return F.coalesce(*[F.when(v == x if how == "is" else v.contains(x), t) for how, x, t in LABEL_TYPES], F.lit("text"))


def ocr_prompt(family: Column, label: Column) -> Column:
    """Prompt for a region, by model family; null for a family that isn't known."""
    v = F.lower(label)
    kind = F.when(v.contains("table"), "table").when(v.contains("formula"), "formula").when(v.isin(*FIGURES), "figure").otherwise("text")
    table = F.create_map(*[F.lit(x) for f, by in PROMPTS.items() for k, p in by.items() for x in (f"{f} {k}", p)])
    return F.element_at(table, F.concat(F.lower(family), F.lit(" "), kind))


def token_cap(label: Column, share: Column) -> Column:
    """Tokens that a region may take."""
    return F.when(F.lower(label).contains("table"), 512).when(share > 0.03, 256).otherwise(128)


def retryable(status: Column, kind: Column) -> Column:
    """Whether a failed call may be tried again."""
    return status.isin(408, 429) | (status >= 500) | kind.isin("transport", "timeout", "parse")


def scan_like(filename: Column, n_words: Column) -> Column:
    """No PDF, or a PDF page without words of its own."""
    return ~F.lower(filename).endswith(".pdf") | (F.coalesce(n_words, F.lit(0)) == 0)


def cache_shard(sha: Column, shards: int = 4) -> Column:
    """Prompt-cache shard of a content hash."""
    return (F.conv(F.substring(sha, 1, 8), 16, 10).cast("long") % shards).cast("int")
