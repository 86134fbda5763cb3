"""Assembly of blocks into a document's Markdown with exact code-point ranges, and its validation.

Blocks are rows ``doc_id, page_seq, page, ord, type, semantic_role, markdown``. All of it is one window over each
document, so one shuffle on ``doc_id`` serves ranges, ids and checks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_GAP, PAGE_GAP = "\n\n", "\n\n<!-- PAGE BREAK -->\n\n"


def with_ranges(blocks: DataFrame) -> DataFrame:
    """Blocks with ``start`` and ``end`` in the document, their per-type ``id`` and pre-order ``seq``."""
    order = Window.partitionBy("doc_id").orderBy("page_seq", "ord")
    gap = F.when(F.row_number().over(order) == 1, 0).when(F.lag("page_seq").over(order) != F.col("page_seq"), len(PAGE_GAP)).otherwise(len(BLOCK_GAP))
    sized = blocks.withColumn("gap", gap).withColumn("seq", F.row_number().over(order))
    end = F.sum(F.col("gap") + F.length("markdown")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    number = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("page_seq", "ord"))
    return sized.withColumn("end", end).withColumn("start", F.col("end") - F.length("markdown")).withColumn("id", F.concat("type", F.lit("-"), number.cast("string")))


def document_text(blocks: DataFrame) -> DataFrame:
    """``doc_id`` and ``markdown`` of whole documents, with the trailing mark that names the document."""
    lines = blocks.groupBy("doc_id", "page_seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "markdown"))), lambda x: x["markdown"]), BLOCK_GAP).alias("text"))
    pages = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_seq", "text"))), lambda x: x["text"]), PAGE_GAP).alias("body"))
    return pages.select("doc_id", F.concat("body", F.lit("\n\n<!-- doc_id="), F.col("doc_id").cast("string"), F.lit(" -->")).alias("markdown"))


def range_violations(ranged: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks whose range is out of order, overlaps the one before, or doesn't slice back to its text (V2, V5, V7)."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    met = ranged.withColumn("before", F.lag("end").over(order)).join(texts.select("doc_id", F.col("markdown").alias("whole")), "doc_id")
    cut = F.col("whole").substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    reason = F.when(F.col("end") < F.col("start"), "range is reversed").when(F.col("start") < F.col("before"), "ranges overlap").when(cut != F.col("markdown"), "range does not hold its text")
    return met.withColumn("violation", reason).where("violation is not null").select("doc_id", "id", "violation")


def node_violation(node: Column) -> Column:
    """The first rule of node shape that a node breaks, or null (V3)."""
    kind = node["type"]
    cell = node["row"].isNotNull() | node["col"].isNotNull()
    return (
        F.when((kind == "document") & node["page"].isNotNull(), "document has no page")
        .when((kind == "page") & node["page"].isNull(), "page needs its number")
        .when(~kind.isin("document", "page") & node["page"].isNull(), "block needs its page")
        .when((kind == "table_cell") & ~cell, "table cell needs row and column")
        .when((kind != "table_cell") & cell, "only table cells have row and column")
        .when((node["grounding_status"] == "grounded") & node["box"].isNull() & ~kind.isin("document", "page"), "grounded node needs a box")
        .when((kind == "table_cell") & (node["parent_type"] != "table"), "table cell belongs in a table")
    )


def page_range_violation(start: Column, end: Column, count: Column) -> Column:
    """What is wrong with a selected page range, or null."""
    last = F.coalesce(end, count)
    return F.when((start < 1) | (last < 1) | (start > last), "invalid_page_range").when(last > count, "invalid_page_range")


#: Messages on metadata, documents and ranges, in the order in which rules are tried.
METADATA_RULES = ("page_range must be ordered and one-based", "page_range cannot exceed source_page_count", "ai_refined_pages must be within page_range")
RESPONSE_RULES = (
    "output_characters must match Markdown Unicode code-point length", "page_count must match structure pages", "pages must be contiguous and ordered", "blocks must belong to their containing page",
    "table cells must be children of tables", "only table cells may be nested beneath a block", "public IDs must be stable <type>-<index> values",
)
RANGE_RULES = (
    "range is outside document Markdown", "grounding ranges must be ordered and non-overlapping", "atomic grounding must be contained by its parent block", "atomic grounding ranges must be ordered and non-overlapping",
    "atomic grounding text must match its Markdown ranges",
)
WORD_RULE = "word grounding text must match its Markdown range"
CELL_RULE = "table cell Markdown must occur in its parent table Markdown"


def _first_broken(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), message) for broken, message in rules])


def metadata_violation(start: Column, end: Column, source_pages: Column, refined: Column) -> Column:
    """The first rule on a selected range (null: all pages) that the metadata break, or null (V4). ``refined``: pages that a model refined."""
    rules = ((start < 1) | (end < start), end > source_pages, F.exists(refined, lambda p: (p < start) | (p > end)))
    return F.when(start.isNotNull() & end.isNotNull(), _first_broken(*zip(rules, METADATA_RULES, strict=True)))


def response_violations(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, id, violation``: documents and nodes that break a rule (V5, V6).

    ``documents``: ``doc_id, markdown, output_characters, page_count``; ``nodes``: ``doc_id, seq`` (pre-order), ``id, type, page`` and ``parent_id``, which is the page's id for
    blocks and the block's for cells. One window over each document numbers its nodes."""
    n = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("seq"))
    own = nodes.where("type <> 'document'").withColumn("expected", F.concat("type", F.lit("-"), n.cast("string")))
    parents = own.select("doc_id", F.col("id").alias("parent_id"), F.col("type").alias("parent_type"), F.col("page").alias("parent_page"))
    met = own.join(parents, ["doc_id", "parent_id"], "left")
    block, cell = F.col("type") != "page", F.col("type") == "table_cell"
    wrong_id = F.col("id") != F.col("expected")
    broken = _first_broken(
        (~block & wrong_id, RESPONSE_RULES[2]), (block & ~F.col("page").eqNullSafe(F.col("parent_page")), RESPONSE_RULES[3]), (cell & ~F.col("parent_type").eqNullSafe(F.lit("table")), RESPONSE_RULES[4]),
        (block & ~cell & ~F.col("parent_type").eqNullSafe(F.lit("page")), RESPONSE_RULES[5]), (wrong_id, RESPONSE_RULES[6]),
    )
    pages = nodes.where("type = 'page'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    whole = documents.join(pages, "doc_id", "left")
    rules = _first_broken((F.col("output_characters") != F.length("markdown"), RESPONSE_RULES[0]), (F.col("page_count") != F.coalesce("pages", F.lit(0)), RESPONSE_RULES[1]))
    said = whole.select("doc_id", F.lit("document-1").alias("id"), rules.alias("violation")).unionByName(met.select("doc_id", "id", broken.alias("violation")))
    return said.where("violation is not null")


def atomic_violations(texts: DataFrame, blocks: DataFrame, atomic: DataFrame) -> DataFrame:
    """``doc_id, id, violation`` of blocks and of their lines, whose range is out of the text, out of order, out of the block's, or doesn't hold their text (V7).

    ``blocks``: ``doc_id, id, start, end``; ``atomic``: ``doc_id, id`` (of the block), ``line, text, start, end``."""
    whole = texts.select("doc_id", F.col("markdown").alias("whole"))
    met = atomic.join(blocks.select("doc_id", "id", F.col("start").alias("from"), F.col("end").alias("to")), ["doc_id", "id"]).join(whole, "doc_id")
    before = F.lag("end").over(Window.partitionBy("doc_id", "id").orderBy("line"))
    cut = F.substring(F.col("whole"), F.col("start") + 1, F.col("end") - F.col("start"))
    rules = (F.col("end") > F.length("whole"), F.col("end") < F.col("start"), (F.col("start") < F.col("from")) | (F.col("end") > F.col("to")), F.col("start") < F.col("before"), cut != F.col("text"))
    lines = met.withColumn("before", before).select("doc_id", "id", _first_broken(*zip(rules, RANGE_RULES, strict=True)).alias("violation"))
    outside = blocks.join(whole, "doc_id").select("doc_id", "id", _first_broken((F.col("end") > F.length("whole"), RANGE_RULES[0]), (F.col("end") < F.col("start"), RANGE_RULES[1])).alias("violation"))
    return outside.unionByName(lines).where("violation is not null")


def word_violations(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Words (``doc_id, text, start, end``) whose range doesn't hold them (V5)."""
    met = words.join(texts.select("doc_id", F.col("markdown").alias("whole")), "doc_id")
    bad = met.where(F.substring(F.col("whole"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"))
    return bad.select("doc_id", "text", "start", F.lit(WORD_RULE).alias("violation"))


def unordered_pages(pages: DataFrame) -> DataFrame:
    """Documents whose physical pages don't come in order."""
    w = Window.partitionBy("doc_id").orderBy("page_seq")
    return pages.withColumn("before", F.lag("page").over(w)).where("before > page").select("doc_id").distinct()


def placements(text: str, needles: Iterable[str | None], wrapped: bool = False) -> Iterator[tuple[int, int] | None]:
    """The range of each needle, found from where the last hit ended, or null; in time that grows with the text and the needles.

    A hit scans no further than itself, and the next search starts there. A needle that isn't found once won't be found later on; and when such
    searches have scanned the text a few times over, the last place of each three characters tells beforehand which needles can't follow."""
    cursor, scanned, lost, last = 0, 0, set(), None

    def search(needle: str, at: int) -> int:
        nonlocal scanned, last
        if needle in lost:
            return -1
        if last is not None and any(last.get(needle[i : i + 3], -1) < at + i for i in range(len(needle) - 2)):
            return -1
        found = text.find(needle, at)
        if found < 0:
            lost.add(needle)
            scanned += len(text) - at
            if last is None and scanned > 8 * len(text):
                last = {text[i : i + 3]: i for i in range(len(text) - 2)}
        return found

    for needle in needles:
        start = -1
        if needle is not None:
            start = search(f">{needle}<", cursor) + 1 if wrapped else 0
            if start < 1:
                start = search(needle, cursor)
        if start < 0:
            yield None
        else:
            cursor = start + len(needle)
            yield start, cursor


def place(markdown: Column, needles: Column, wrapped: bool = False, skip: bool = True) -> Column:
    """Ranges of texts found one after the other, each from where the last one ended.

    ``wrapped``: prefer a place right between ``>`` and ``<``, as table cells have. ``skip``: leave out texts that
    aren't found; else they stay with a null range."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def starts(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([None if text is None or words is None else [at and at[0] for at in placements(text, words, wrapped)] for text, words in zip(texts, wanted, strict=True)], dtype=object)

    found = F.zip_with(needles, starts(markdown, needles), lambda w, at: F.struct(w.alias("text"), at.alias("start"), (at + F.length(w)).alias("end")))
    return F.filter(found, lambda x: x["start"].isNotNull()) if skip else found


def nest_cells(chunks: DataFrame) -> DataFrame:
    """Cells that name a table of their page as parent, with ``nested``: whether the table's text holds them, one after the other; then with their
    range in it, and row 0 and the running column where none is given (J11). Cells that it doesn't hold stay as blocks of their own."""
    cells = chunks.where("type = 'table_cell' and parent_id is not null").groupBy("doc_id", "page", "parent_id").agg(F.array_sort(F.collect_list(F.struct("order", "id", "markdown", "row", "col"))).alias("cells"))
    tables = chunks.where("type = 'table'").select("doc_id", "page", F.col("id").alias("parent_id"), F.col("markdown").alias("table"))
    met = tables.join(cells, ["doc_id", "page", "parent_id"])
    placed = met.withColumn("placed", place(F.col("table"), F.transform("cells", lambda c: c["markdown"]), skip=False))
    out = placed.select("doc_id", "page", "parent_id", F.posexplode(F.arrays_zip("cells", "placed")).alias("i", "c")).select("doc_id", "page", "parent_id", "i", "c.cells.*", "c.placed.start", "c.placed.end")
    there = F.col("start").isNotNull()
    return out.select("doc_id", "page", "parent_id", "id", F.when(there, F.coalesce("row", F.lit(0))).alias("row"), F.when(there, F.coalesce("col", "i")).alias("col"), "start", "end", there.alias("nested"))


def cell_violations(tables: DataFrame) -> DataFrame:
    """Cells of assembled tables (``doc_id, id, markdown, cells``, an array of texts) that their table's text doesn't hold, at or after the one before."""
    placed = tables.select("doc_id", "id", F.posexplode(place(F.col("markdown"), F.col("cells"), wrapped=True, skip=False)).alias("cell", "p"))
    return placed.where("p.start is null").select("doc_id", "id", "cell", F.lit(CELL_RULE).alias("violation"))
