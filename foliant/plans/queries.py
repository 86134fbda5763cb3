"""Queries over the driver's tables, one or more for each operator of the survey, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance, markdown, schema
from ..functions import geometry as G
from ..functions import text as X
from ..operators import align, assemble, batch, export, ingest, jobs, organize, quality, reconcile, relations, resolve, routing, trees, usage
from ..sources import files, headers
from ..sources import fixtures as S
from ..sources.storage import shared_folder
from ..streaming import store
from .catalogue import query

CLASSES = [("Greeting", "sombra the then"), ("Finance", "quel account payment"), ("Travel", "schen hotel flight")]
PRICES = [("model-0", 2.0, 6.0, 0.5), ("model-1", 0.2, 1.2, 0.02), ("model-2", 0.3, 2.5, 0.0)]
AS_OF = "2024-01-31 00:00:00"
PROFILES = {("docling", "local", "1"): [(0.0, 0.1), (0.25, 0.2), (0.5, 0.65), (1.0, 0.9)], ("ocr", "glm", "2"): [(0.1, 0.0), (0.9, 1.0)]}

_BLOCKS = """
WITH lines AS (
  SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, role,
         unnest(string_split(text, chr(10))) AS markdown, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS ord
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
blocks AS (
  SELECT doc_id, page, ord, CASE WHEN role = 'system' THEN 'marginalia' ELSE 'text' END AS type,
         CASE WHEN ord = 1 THEN 'heading' END AS semantic_role, markdown FROM lines),
gapped AS (
  SELECT *, CAST(row_number() OVER w AS INTEGER) AS seq,
         CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(page) OVER w <> page THEN 23 ELSE 2 END AS gap
  FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page, ord)),
ranged AS (
  SELECT *, CAST(sum(gap + length(markdown)) OVER (PARTITION BY doc_id ORDER BY page, ord) AS BIGINT) AS "end",
         CAST(sum(gap + length(markdown)) OVER (PARTITION BY doc_id ORDER BY page, ord) AS BIGINT) - length(markdown) AS start,
         type || '-' || CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY page, ord) AS VARCHAR) AS id
  FROM gapped),
pagetext AS (
  SELECT doc_id, page, min(start) AS start, max("end") AS "end", string_agg(markdown, chr(10) || chr(10) ORDER BY ord) AS text
  FROM ranged GROUP BY doc_id, page)
"""


def _ranged(spark: SparkSession, d: str) -> DataFrame:
    return assemble.with_ranges(S.conversation_blocks(spark, d))


def _lit_pairs(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in values)


# --- assembly and export -------------------------------------------------------------------------------------------


@query("assemble_ranges", _BLOCKS + 'SELECT doc_id, page, ord, start, "end", length(markdown) AS n FROM ranged')
def assemble_ranges(spark, d):
    return _ranged(spark, d).select("doc_id", "page", "ord", "start", "end", F.length("markdown").cast("long").alias("n"))


@query("assembled_markdown", _BLOCKS + """, pages AS (SELECT doc_id, page, string_agg(markdown, chr(10) || chr(10) ORDER BY ord) AS t FROM blocks GROUP BY doc_id, page)
SELECT doc_id, string_agg(t, chr(10) || chr(10) || '<!-- PAGE BREAK -->' || chr(10) || chr(10) ORDER BY page) || chr(10) || chr(10) || '<!-- doc_id=' || CAST(doc_id AS VARCHAR) || ' -->' AS markdown FROM pages GROUP BY doc_id""")
def assembled_markdown(spark, d):
    return assemble.document_text(S.conversation_blocks(spark, d))


@query("stable_ids", _BLOCKS + "SELECT doc_id, seq, type, id FROM ranged")
def stable_ids(spark, d):
    return _ranged(spark, d).select("doc_id", "seq", "type", "id")


_BROKEN = _BLOCKS + """, texts AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) || '<!-- PAGE BREAK -->' || chr(10) || chr(10) ORDER BY page) || chr(10) || chr(10) || '<!-- doc_id=' || CAST(doc_id AS VARCHAR) || ' -->' AS whole FROM (SELECT doc_id, page, string_agg(markdown, chr(10) || chr(10) ORDER BY ord) AS t FROM blocks GROUP BY doc_id, page) GROUP BY doc_id),
broken AS (SELECT r.*, start - CASE WHEN seq % 7 = 0 THEN 3 ELSE 0 END AS a, "end" + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS z, whole FROM ranged r JOIN texts USING (doc_id))
"""


def _broken(spark, d):
    """Ranged blocks, some of which begin too early or end too late, and the texts."""
    blocks = S.conversation_blocks(spark, d)
    ranged = assemble.with_ranges(blocks)
    off = ranged.withColumns({"start": F.col("start") - F.when(F.col("seq") % 7 == 0, 3).otherwise(0), "end": F.col("end") + F.when(F.col("seq") % 5 == 0, 1).otherwise(0)})
    return off, assemble.document_text(blocks)


@query("range_checks", _BROKEN + """, told AS (SELECT doc_id, id, CASE WHEN z < a THEN 'range is reversed' WHEN a < lag(z) OVER (PARTITION BY doc_id ORDER BY seq) THEN 'ranges overlap' WHEN substr(whole, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) <> markdown THEN 'range does not hold its text' END AS violation FROM broken)
SELECT * FROM told WHERE violation IS NOT NULL""")
def range_checks(spark, d):
    return assemble.range_violations(*_broken(spark, d))


@query("atomic_checks", _BROKEN + """, told AS (SELECT doc_id, id, CASE WHEN "end" > length(whole) THEN 'range is outside document Markdown' END AS violation FROM broken
UNION ALL SELECT doc_id, id, CASE WHEN a < start OR z > "end" THEN 'atomic grounding must be contained by its parent block' WHEN seq % 6 = 0 AND length(markdown) > 0 THEN 'atomic grounding text must match its Markdown ranges' END FROM broken)
SELECT * FROM told WHERE violation IS NOT NULL""")
def atomic_checks(spark, d):
    off, texts = _broken(spark, d)
    lines = off.select("doc_id", "id", F.lit(0).alias("line"), F.when(F.col("seq") % 6 == 0, F.concat("markdown", F.lit("?"))).otherwise(F.col("markdown")).alias("text"), "start", "end").where("length(text) <> 1 or text <> '?'")
    return assemble.atomic_violations(texts, _ranged(spark, d), lines)


@query("response_checks", _BROKEN + """, pages AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM (SELECT DISTINCT doc_id, page FROM ranged)),
docs AS (SELECT doc_id, length(whole) AS n, (SELECT count(*) FROM pages p WHERE p.doc_id = t.doc_id) AS pages FROM texts t),
told AS (SELECT doc_id, 'document-1' AS id, CASE WHEN doc_id % 3 = 0 THEN 'output_characters must match Markdown Unicode code-point length' WHEN doc_id % 4 = 0 THEN 'page_count must match structure pages' END AS violation FROM docs
UNION ALL SELECT doc_id, 'page-' || CAST(n AS VARCHAR) || '.', 'pages must be contiguous and ordered' FROM pages WHERE doc_id % 5 = 0 AND n = 2
UNION ALL SELECT b.doc_id, b.id || CASE WHEN seq % 11 = 0 THEN '.' ELSE '' END, CASE WHEN seq % 9 = 0 THEN 'blocks must belong to their containing page' WHEN seq % 13 = 0 AND NOT (b.doc_id % 5 = 0 AND p.n = 2) THEN 'only table cells may be nested beneath a block' WHEN seq % 11 = 0 THEN 'public IDs must be stable <type>-<index> values' END
  FROM broken b JOIN pages p ON b.doc_id = p.doc_id AND b.page = p.page)
SELECT * FROM told WHERE violation IS NOT NULL""")
def response_checks(spark, d):
    ranged, texts = _ranged(spark, d), _broken(spark, d)[1]
    w = Window.partitionBy("doc_id").orderBy("page")
    pages = ranged.select("doc_id", "page").distinct().withColumn("n", F.row_number().over(w))
    page_id = F.concat(F.lit("page-"), F.col("n").cast("string"), F.when((F.col("doc_id") % 5 == 0) & (F.col("n") == 2), ".").otherwise(""))
    pages = pages.select("doc_id", F.col("n").alias("seq"), page_id.alias("id"), F.lit("page").alias("type"), "page", F.lit("document-1").alias("parent_id"))
    odd = lambda k: F.col("seq") % k == 0
    own = ranged.join(pages.select("doc_id", "page", F.col("id").alias("page_id")), ["doc_id", "page"])
    first = own.groupBy("doc_id").agg(F.min_by("id", F.when(~odd(11), F.col("seq"))).alias("other"), F.min_by("page", F.when(~odd(11), F.col("seq"))).alias("other_page"))
    own = own.join(first, "doc_id")
    nested = odd(13) & ~odd(9) & ~((F.col("doc_id") % 5 == 0) & F.col("page_id").endswith("."))
    blocks = own.select("doc_id", "seq", F.when(odd(11), F.concat("id", F.lit("."))).otherwise(F.col("id")).alias("id"), "type", F.when(odd(9), -1).when(nested, F.col("other_page")).otherwise(F.col("page")).alias("page"), F.when(nested, F.col("other")).otherwise(F.col("page_id")).alias("parent_id"))
    told = assemble.response_violations(
        texts.join(pages.groupBy("doc_id").count(), "doc_id").select("doc_id", "markdown", (F.length("markdown") + (F.col("doc_id") % 3 == 0).cast("int")).alias("output_characters"), (F.col("count") + (F.col("doc_id") % 4 == 0).cast("int")).alias("page_count")), pages.unionByName(blocks)
    )
    return told.where("not (id like 'page-%' and violation like 'blocks must%')")


@query("metadata_checks", """WITH c AS (SELECT conv_id AS doc_id, CAST(max(turn) + 1 AS INTEGER) AS n FROM conversations GROUP BY conv_id),
m AS (SELECT doc_id, 1 + doc_id % 4 - doc_id % 3 AS a, CASE WHEN doc_id % 9 <> 0 THEN n END AS z, n - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS pages, [1, 1 + doc_id % 4, n + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END] AS refined FROM c)
SELECT doc_id, CASE WHEN z IS NULL THEN NULL WHEN a < 1 OR z < a THEN 'page_range must be ordered and one-based' WHEN z > pages THEN 'page_range cannot exceed source_page_count' WHEN len(list_filter(refined, lambda p: p < a OR p > z)) > 0 THEN 'ai_refined_pages must be within page_range' END AS violation FROM m""")
def metadata_checks(spark, d):
    c = S.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg((F.max("turn") + 1).cast("int").alias("n"))
    k, n = F.col("doc_id"), F.col("n")
    refined = F.array(F.lit(1).cast("long"), 1 + k % 4, (n + (k % 11 == 0).cast("int")).cast("long"))
    return c.select("doc_id", assemble.metadata_violation(1 + k % 4 - k % 3, F.when(k % 9 != 0, n), n - (k % 7 == 0).cast("int"), refined).alias("violation"))


@query("section_warnings", _BLOCKS + "SELECT doc_id, page, 'Page ' || CAST(page AS VARCHAR) || ': no explicit heading; first grounded block used as a partial' AS warning FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS rn FROM ranged WHERE ord > 1) WHERE rn = 1")
def section_warnings(spark, d):
    return organize.section_warnings(organize.sections(_ranged(spark, d).where("ord > 1")))


@query("node_export", _BLOCKS + """, b AS (SELECT doc_id, page, type, type || '-' || CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY seq) - 1 AS VARCHAR) AS node_id, start, "end" FROM ranged),
p AS (SELECT doc_id, page, 'page' AS type, 'page-' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS VARCHAR) AS node_id, min(start) AS start, max("end") AS "end" FROM ranged GROUP BY doc_id, page)
SELECT * FROM b UNION ALL SELECT * FROM p""")
def node_export(spark, d):
    return export.export_nodes(_ranged(spark, d).withColumn("box", F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>"))).select("doc_id", "page", "type", "node_id", "start", "end")


@query("export_json")
def export_json(spark, d):
    blocks = S.conversation_blocks(spark, d)
    nodes = export.export_nodes(assemble.with_ranges(blocks).withColumn("box", F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>")))
    return export.export_json(nodes, assemble.document_text(blocks))


@query("content_nodes", _BLOCKS + "SELECT doc_id, seq, type || '-' || CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY seq) - 1 AS VARCHAR) AS node_id FROM ranged")
def content_nodes(spark, d):
    nodes = export.export_nodes(_ranged(spark, d).withColumn("box", F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>")))
    return export.content_nodes(nodes).select("doc_id", "seq", "node_id")


@query("archive_manifest", """WITH e AS (SELECT page_id + 1 AS seq, CASE WHEN page_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, regexp_replace(url, '^.*/', '') AS leaf, page_id FROM pages),
s AS (SELECT *, CASE WHEN contains(leaf, '.') THEN regexp_extract(leaf, '^(.*)\\.[^.]*$', 1) ELSE leaf END AS base FROM e),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(base, '[^A-Za-z0-9._-]+', '-', 'g'), '^[ ._-]+', ''), '[ ._-]+$', '') AS stem0 FROM s),
u AS (SELECT *, coalesce(nullif(substr(stem0, 1, 80), ''), 'document') AS stem FROM t)
SELECT seq, printf('%02d-', seq) || stem AS folder, status, CASE WHEN status = 'failed' THEN 0 WHEN page_id % 3 = 0 THEN 1 ELSE 2 END AS n_files FROM u""")
def archive_manifest(spark, d):
    p = S.table(spark, d, "pages").select((F.col("page_id") + 1).alias("seq"), F.col("url").alias("filename"), F.when(F.col("page_id") % 7 == 0, "failed").otherwise("completed").alias("status"), F.lit("x").alias("markdown"), F.when(F.col("page_id") % 3 != 0, F.col("html")).alias("html"))
    return export.archive_manifest(p).select("seq", "folder", "status", F.size("files").alias("n_files"))


_BOXES = """WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS f FROM embeddings),
s AS (SELECT label AS page, vec_id AS seq, least(abs(a), 0.5) AS l, least(abs(b), 0.5) AS t, c, f FROM e),
boxes AS (SELECT page, seq, l, t, l + 0.1 + least(abs(c), 0.4) AS r, t + 0.1 + least(abs(f), 0.4) AS b FROM s),
pairs AS (SELECT x.page, x.seq AS a, y.seq AS b, greatest(0.0, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0.0, least(x.b, y.b) - greatest(x.t, y.t)) / least((x.r - x.l) * (x.b - x.t), (y.r - y.l) * (y.b - y.t)) AS overlap
  FROM boxes x JOIN boxes y ON x.page = y.page AND x.seq < y.seq)
"""


@query("archive_entries", """WITH p AS (SELECT page_id, url, html, page_id % 7 = 0 AS bad FROM pages)
SELECT page_id AS seq, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN CASE WHEN page_id % 2 = 0 THEN 'broken' ELSE 'Parsing failed' END WHEN page_id % 5 = 0 THEN 'no drawing' END AS error, CASE WHEN bad THEN 0 ELSE CAST(length(html) AS INTEGER) END AS n, NOT bad AND page_id % 5 <> 0 AS drawn FROM p""")
def archive_entries(spark, d):
    k = F.col("page_id")
    p = S.table(spark, d, "pages").select(k.alias("file_id"), k.alias("seq"), F.col("url").alias("filename"), "html", F.when(k % 7 == 0, "failed").otherwise("completed").alias("status"), F.when(k % 2 == 0, "broken").alias("error"))
    exports = p.where("status = 'completed'").select("file_id", F.col("html").alias("markdown"), "html", F.lit("{}").alias("export_json"), F.lit("{}").alias("ade_json"))
    artifacts = p.select("file_id", F.when(F.col("file_id") % 5 != 0, F.encode("filename", "utf-8")).alias("annotated_pdf"), F.when(F.col("file_id") % 5 == 0, "no drawing").alias("artifact_error"))
    out = export.archive_entries(p.drop("html"), exports, artifacts)
    return out.select("seq", "status", "error", F.coalesce(F.length("html"), F.lit(0)).alias("n"), F.col("annotated_pdf").isNotNull().alias("drawn"))


@query("annotation_counts", _BOXES + "SELECT page AS doc_id, count(*) FILTER (seq % 12 + 1 <= 10) AS annotated, count(*) FILTER (seq % 12 + 1 > 10) AS semantic FROM boxes GROUP BY page")
def annotation_counts(spark, d):
    b = S.embedding_boxes(spark, d).select(F.col("page").alias("doc_id"), "box", (F.col("seq") % 12 + 1).alias("page"), F.lit(10).alias("source_page_count"))
    return export.annotation_counts(b)


@query("draw_list", _BOXES + "SELECT page AS doc_id, round(l * 612, 6) AS l, round(t * 792, 6) AS t, round(r * 612, 6) AS r, round(b * 792, 6) AS b FROM boxes")
def draw_list(spark, d):
    b = S.embedding_boxes(spark, d).select(F.col("page").alias("doc_id"), "box", "page", F.lit(612).alias("width"), F.lit(792).alias("height"))
    return export.draw_list(b).select("doc_id", *[F.round(s, 6).alias(s[0]) for s in ("left", "top", "right", "bottom")])


# --- organise and relate -------------------------------------------------------------------------------------------


def _class_sql() -> str:
    terms = organize.class_terms(CLASSES)
    values = [(i, n, t, j) for i, ((n, _), ts) in enumerate(zip(CLASSES, terms, strict=True)) for j, t in enumerate(ts)]
    return _BLOCKS + f""", terms(ci, name, term, ti) AS (VALUES {_lit_pairs(values)}),
hits AS (SELECT p.doc_id, p.page, t.name, t.term, row_number() OVER (PARTITION BY p.doc_id, p.page ORDER BY ci, ti) AS rn
  FROM pagetext p JOIN terms t ON contains(replace(lower(p.text), 'ß', 'ss'), t.term)),
classified AS (SELECT p.*, coalesce(h.name, '{CLASSES[0][0]}') AS label, coalesce('Matched source term: ' || h.term, '{organize.NO_MATCH}') AS reason
  FROM pagetext p LEFT JOIN hits h ON p.doc_id = h.doc_id AND p.page = h.page AND h.rn = 1)
"""


@query("classify_pages", _class_sql() + 'SELECT doc_id, page, label, reason, start, "end" FROM classified')
def classify_pages(spark, d):
    return organize.classify(organize.page_texts(_ranged(spark, d)), CLASSES).select("doc_id", "page", "label", "reason", "start", "end")


@query("split_documents", _class_sql() + """, g AS (SELECT doc_id, label, min(page) AS first, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, string_agg(text, chr(10) || chr(10) || '<!-- PAGE BREAK -->' || chr(10) || chr(10) ORDER BY page) AS markdown FROM classified GROUP BY doc_id, label)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) AS INTEGER) AS position, label, pages, markdown FROM g""")
def split_documents(spark, d):
    out = organize.split(organize.classify(organize.page_texts(_ranged(spark, d)), CLASSES))
    return out.select("doc_id", "position", "label", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), "markdown")


@query("section_documents", _BLOCKS + """, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS rn FROM ranged)
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS section_number, substr(coalesce(nullif(trim(markdown), ''), 'Untitled section'), 1, 160) AS title, id AS start_reference, start, "end", coalesce(semantic_role NOT IN ('title', 'heading'), true) AS partial FROM f WHERE rn = 1""")
def section_documents(spark, d):
    return organize.sections(_ranged(spark, d))


_KEYED = """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS ord FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(regexp_replace(replace(lower(line), 'ß', 'ss'), '\\s+', ' ', 'g')) AS key FROM lines)
"""


@query("relations_marginalia", _KEYED + "SELECT doc_id, ord, n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM keyed WHERE key <> '') WHERE n > 1")
def relations_marginalia(spark, d):
    b = S.document_lines(spark, d).select("doc_id", F.lit(1).alias("page"), F.col("ord").alias("id"), F.lit("marginalia").alias("type"), F.col("line").alias("markdown"))
    return relations.repeated_marginalia(b).select("doc_id", F.col("block_id").alias("ord"), "n")


@query("relations_sections", _BLOCKS + "SELECT doc_id, page, id AS block_id, nullif(markdown, '') AS title FROM ranged WHERE semantic_role = 'heading'")
def relations_sections(spark, d):
    return relations.section_starts(_ranged(spark, d))


@query("relations_boundary", "WITH c AS (SELECT conv_id AS doc_id, CAST(max(turn) + 1 AS INTEGER) AS n FROM conversations GROUP BY conv_id) SELECT doc_id, CAST(1 + doc_id % 2 AS INTEGER) AS first_page, n AS last_page FROM c WHERE doc_id % 2 = 1")
def relations_boundary(spark, d):
    c = S.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg((F.max("turn") + 1).cast("int").alias("source_page_count"))
    docs = c.withColumns({"first_page": (1 + F.col("doc_id") % 2).cast("int"), "last_page": F.col("source_page_count")})
    return relations.selection_boundaries(docs).select("doc_id", "first_page", "last_page")


_TABLES = """WITH rows_ AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_seq, CAST(l_partkey % 3 AS INTEGER) AS columns, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem),
ends AS (SELECT doc_id, page_seq, arg_max(columns, ord) AS last_columns, arg_min(columns, ord) AS first_columns, max(ord) AS last_ord, min(ord) AS first_ord FROM rows_ GROUP BY doc_id, page_seq),
n AS (SELECT *, lead(page_seq) OVER w AS to_page, lead(first_columns) OVER w AS to_columns, lead(first_ord) OVER w AS to_ord FROM ends WINDOW w AS (PARTITION BY doc_id ORDER BY page_seq))
SELECT doc_id, page_seq AS from_page, to_page, CAST(last_ord AS INTEGER) AS from_id, CAST(to_ord AS INTEGER) AS to_id, last_columns AS column_count FROM n WHERE to_page = page_seq + 1 AND last_columns > 0 AND last_columns = to_columns"""


@query("continued_tables", _TABLES)
def continued_tables(spark, d):
    w = Window.partitionBy("doc_id", "page_seq").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    t = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_seq"), (F.col("l_partkey") % 3).cast("int").alias("columns"), "l_partkey", "l_suppkey", "l_extendedprice")
    t = t.withColumn("ord", F.row_number().over(w)).withColumn("id", F.col("ord"))
    return relations.continued_tables(t.select("doc_id", "page_seq", "ord", "id", "columns"))


@query("all_relations", _BLOCKS + """, firsts AS (SELECT doc_id, page, id, length(markdown) % 3 AS columns, lead(page) OVER w AS to_page, lead(id) OVER w AS to_id, lead(length(markdown) % 3) OVER w AS to_columns FROM ranged WHERE ord = 1 WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
keyed AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM (SELECT doc_id, page, id, trim(regexp_replace(replace(lower(markdown), 'ß', 'ss'), '\\s+', ' ', 'g')) AS key FROM ranged WHERE type = 'marginalia') WHERE key <> '')
SELECT doc_id, page, id AS block_id, nullif(markdown, '') AS title, 'section_start' AS kind, NULL::INTEGER AS from_page, NULL::INTEGER AS to_page, NULL AS from_id, NULL AS to_id, NULL::INTEGER AS column_count, NULL::INTEGER AS first_page, NULL::INTEGER AS last_page, NULL AS warning FROM ranged WHERE semantic_role = 'heading'
UNION ALL SELECT doc_id, page, id, NULL, 'repeated_marginalia', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM keyed WHERE n > 1
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'continued_table', page, to_page, id, to_id, columns, NULL, NULL, NULL FROM firsts WHERE to_page = page + 1 AND columns > 0 AND columns = to_columns
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'selection_boundary', NULL, NULL, NULL, NULL, NULL, 1, max(page), 'Pages outside the selected range were not inspected.' FROM ranged GROUP BY doc_id""")
def all_relations(spark, d):
    b = _ranged(spark, d)
    docs = b.groupBy("doc_id").agg(F.max("page").alias("last_page")).withColumns({"first_page": F.lit(1), "source_page_count": F.col("last_page") + 1})
    tables = b.where("ord = 1").select("doc_id", "page_seq", "ord", "id", (F.length("markdown") % 3).alias("columns"))
    return relations.all_relations(b, tables, docs)


# --- boxes and page quality ----------------------------------------------------------------------------------------


@query("box_overlap_pairs", _BOXES + "SELECT page, a, b, round(overlap, 6) AS overlap FROM pairs WHERE overlap >= 0.5")
def box_overlap_pairs(spark, d):
    return quality.overlapping_pairs(S.embedding_boxes(spark, d), ["page"]).withColumn("overlap", F.round("overlap", 6))


@query("best_overlap", _BOXES + """, m AS (SELECT x.page, x.seq AS candidate, y.seq AS draft, greatest(0.0, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0.0, least(x.b, y.b) - greatest(x.t, y.t)) / least((x.r - x.l) * (x.b - x.t), (y.r - y.l) * (y.b - y.t)) AS overlap
  FROM boxes x JOIN boxes y ON x.page = y.page AND x.seq % 5 = 0 AND y.seq % 5 <> 0)
SELECT page, candidate, draft, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY page, candidate ORDER BY overlap DESC, draft DESC) AS rn FROM m) WHERE rn = 1""")
def best_overlap(spark, d):
    b = S.embedding_boxes(spark, d)
    return quality.best_overlap(b.where("seq % 5 = 0"), b.where("seq % 5 <> 0"), ["page"]).withColumn("overlap", F.round("overlap", 6))


@query("box_rules", _BOXES + "SELECT seq, (l * 2 >= 0 AND l * 2 <= 1 AND r <= 1 AND l * 2 < r AND t < b AND b <= 1) AS valid FROM boxes")
def box_rules(spark, d):
    b = F.col("box")
    return S.embedding_boxes(spark, d).select("seq", G.is_valid(G.box(b["left"] * 2, b["top"], b["right"], b["bottom"])).alias("valid"))


@query("model_boxes", _BOXES + """, k AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN 1000.0 WHEN seq % 3 = 1 THEN 1.0 ELSE -1.0 END AS k, l, t, r, b FROM boxes)
SELECT seq, round(CASE WHEN k = 1000.0 THEN l * 1000 / 1000 ELSE l END, 6) AS l, round(CASE WHEN k = 1000.0 THEN b * 1000 / 1000 ELSE b END, 6) AS b FROM k WHERE k > 0 AND r <= 1 AND b <= 1""")
def model_boxes(spark, d):
    k = F.when(F.col("seq") % 3 == 0, 1000.0).when(F.col("seq") % 3 == 1, 1.0).otherwise(-1.0)
    b = F.col("box")
    out = S.embedding_boxes(spark, d).select("seq", G.parse_model_box(G.box(*[b[s] * k for s in G.SIDES])).alias("p")).where("p is not null")
    return out.select("seq", F.round("p.left", 6).alias("l"), F.round("p.bottom", 6).alias("b"))


@query("crop_boxes", _BOXES + "SELECT seq, round_even(0.2 + l * 0.6, 8) AS l, round_even(0.25 + t * 0.5, 8) AS t, round(greatest(0.0, l - 0.02), 6) AS padded_left, round(least(1.0, r + 0.02), 6) AS padded_right, round(l * 612, 6) AS source_left FROM boxes")
def crop_boxes(spark, d):
    b = F.col("box")
    inner = G.crop_to_page(G.box(0.2, 0.25, 0.8, 0.75), b)
    pad = G.padded(b, 0.02)
    return S.embedding_boxes(spark, d).select("seq", inner["left"].alias("l"), inner["top"].alias("t"), F.round(pad["left"], 6).alias("padded_left"), F.round(pad["right"], 6).alias("padded_right"), F.round(G.source_box(b, F.lit(612), F.lit(792))["left"], 6).alias("source_left"))


@query("native_words", _BOXES + "SELECT seq, round(least(1.0, l * 800 / 612), 6) AS l, round(greatest(0.0, least(1.0, (792 - t * 792) / 792)), 6) AS flipped FROM boxes WHERE least(1.0, l * 800 / 612) < least(1.0, r * 800 / 612)")
def native_words(spark, d):
    b = F.col("box")
    points = G.box(b["left"] * 800, b["top"] * 792, b["right"] * 800, b["bottom"] * 792)
    flipped = G.box(b["left"] * 800, b["bottom"] * 792, b["right"] * 800, b["top"] * 792)
    out = S.embedding_boxes(spark, d).select("seq", G.normalize_points(points, F.lit(612), F.lit(792)).alias("a"), G.normalize_points(flipped, F.lit(612), F.lit(792), bottom_left=True).alias("f"))
    return out.where("a is not null").select("seq", F.round("a.left", 6).alias("l"), F.round("f.bottom", 6).alias("flipped"))


@query("union_boxes", _BOXES + "SELECT page, round(min(l), 6) AS l, round(min(t), 6) AS t, round(max(r), 6) AS r, round(max(b), 6) AS b FROM boxes GROUP BY page")
def union_boxes(spark, d):
    return ingest.union_boxes(S.embedding_boxes(spark, d), ["page"]).select("page", *[F.round(f"box.{s}", 6).alias(s[0]) for s in G.SIDES])


@query("ocr_words", _BOXES + "SELECT seq, round(greatest(0.0, l * 700 / 612), 6) AS l, round(least(1.0, r * 700 / 612), 6) AS r, round(least(1.0, b), 6) AS b, least(1.0, greatest(0.0, seq % 7 / 5.0 - 0.2)) AS confidence FROM boxes WHERE seq % 5 <> 0 AND l * 700 / 612 < least(1.0, r * 700 / 612) AND t < least(1.0, b)")
def ocr_words(spark, d):
    b = F.col("box")
    corner = lambda x, y: F.struct((b[x] * 700).alias("x"), (b[y] * 792).alias("y"))
    word = F.struct(F.when(F.col("seq") % 5 != 0, "w").otherwise("").alias("text"), (F.col("seq") % 7 / 5.0 - 0.2).alias("confidence"), F.array(corner("right", "top"), corner("left", "top"), corner("left", "bottom"), corner("right", "bottom")).alias("points"))
    w = S.embedding_boxes(spark, d).select("seq", F.explode(G.ocr_words(F.array(word), F.lit(612), F.lit(792))).alias("w"))
    return w.select("seq", F.round("w.box.left", 6).alias("l"), F.round("w.box.right", 6).alias("r"), F.round("w.box.bottom", 6).alias("b"), "w.confidence")


@query("crop_pixels", _BOXES + """, p AS (SELECT seq, greatest(0, CAST(trunc((l - (r - l) * 0.05) * 612) AS INTEGER)) AS x, greatest(0, CAST(trunc((t - (b - t) * 0.05) * 792) AS INTEGER)) AS y, CAST(trunc((r + (r - l) * 0.05) * 612) AS INTEGER) AS x2, CAST(trunc((b + (b - t) * 0.05) * 792) AS INTEGER) AS y2 FROM boxes)
SELECT seq, x, y, least(612, greatest(x + 1, x2)) AS x2, least(792, greatest(y + 1, y2)) AS y2, CASE WHEN seq % 2 = 0 THEN 'pdf_points' ELSE 'image_pixels' END AS unit FROM p""")
def crop_pixels(spark, d):
    p = S.embedding_boxes(spark, d).select("seq", G.crop_pixels(F.col("box"), F.lit(612), F.lit(792)).alias("p"), G.source_unit(F.when(F.col("seq") % 2 == 0, "a.PDF").otherwise("a.png")).alias("unit"))
    return p.select("seq", F.col("p.left").alias("x"), F.col("p.top").alias("y"), F.col("p.right").alias("x2"), F.col("p.bottom").alias("y2"), "unit")


@query("turned_crops", _BOXES + """, p AS (SELECT seq, seq % 2 = 0 AS aside, greatest(0, CAST(trunc((l - (r - l) * 0.05) * 200) AS INTEGER)) AS x, greatest(0, CAST(trunc((t - (b - t) * 0.05) * 792) AS INTEGER)) AS y, CAST(trunc((r + (r - l) * 0.05) * 200) AS INTEGER) AS x2, CAST(trunc((b + (b - t) * 0.05) * 792) AS INTEGER) AS y2 FROM boxes),
c AS (SELECT seq, aside, least(200, greatest(x + 1, x2)) - x AS w, least(792, greatest(y + 1, y2)) - y AS h FROM p)
SELECT seq, CASE WHEN aside AND h > w * 2 THEN h ELSE w END AS width, CASE WHEN aside AND h > w * 2 THEN w ELSE h END AS height, aside AND h > w * 2 AS turned FROM c""")
def turned_crops(spark, d):
    label = F.when(F.col("seq") % 2 == 0, "Aside_Text").otherwise("text")
    return S.embedding_boxes(spark, d).select("seq", G.crop_size(label, G.crop_pixels(F.col("box"), F.lit(200), F.lit(792))).alias("c")).select("seq", "c.*")


def _chunks(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["text", "table", "figure", "heading", "chart"])), (F.col("seq") % 5 + 1).cast("int"))
    return S.embedding_boxes(spark, d).withColumns({"type": kind, "parent_id": F.when(F.col("seq") % 4 == 0, "p"), "text": F.concat(F.lit("Item "), (F.col("seq") % 97).cast("string"))})


_CHUNK_SQL = _BOXES + """, chunks AS (SELECT *, list_extract(['text', 'table', 'figure', 'heading', 'chart'], CAST(seq % 5 + 1 AS BIGINT)) AS type, CASE WHEN seq % 4 = 0 THEN 'p' END AS parent_id, 'item ' || CAST(seq % 97 AS VARCHAR) AS key FROM boxes)
"""


@query("page_quality", _CHUNK_SQL + """, o AS (SELECT DISTINCT page FROM pairs WHERE overlap >= 0.5 AND a % 4 <> 0 AND b % 4 <> 0),
q AS (SELECT page, count(key) <> count(DISTINCT key) AS dup, bool_or(type IN ('table', 'table_cell', 'form_field', 'checkbox')) AS risky FROM chunks GROUP BY page)
SELECT q.page, array_to_string(list_filter([CASE WHEN o.page IS NOT NULL THEN 'overlapping_siblings' END, CASE WHEN dup THEN 'duplicate_text' END, CASE WHEN risky THEN 'complex_layout' END], lambda x: x IS NOT NULL), ',') AS reasons FROM q LEFT JOIN o ON q.page = o.page""")
def page_quality(spark, d):
    return quality.page_quality(_chunks(spark, d), ["page"]).select("page", F.array_join("reasons", ",").alias("reasons"))


@query("figure_gate", _CHUNK_SQL + """, a AS (SELECT page, CASE WHEN type IN ('figure', 'chart') THEN (r - l) * (b - t) * (0.02 + seq % 3 * 0.02) END AS area FROM chunks)
SELECT page, coalesce(max(area) >= 0.12, false) OR coalesce(count(area) >= 2 AND max(area) >= 0.04 AND sum(area) >= 0.08, false) AS needs_figures FROM (SELECT * FROM a) GROUP BY page""")
def figure_gate(spark, d):
    # boxes shrunk so that the gate decides both ways
    k = 0.02 + F.col("seq") % 3 * 0.02
    b = F.col("box")
    small = _chunks(spark, d).withColumn("box", G.box(F.lit(0.0), F.lit(0.0), (b["right"] - b["left"]) * (b["bottom"] - b["top"]) * k, F.lit(1.0)))
    return quality.figure_gate(small, ["page"])


@query("uncovered_ink", _BOXES + """, px AS (SELECT p.page, x.i AS x, y.i AS y, (x.i * 7 + y.i * 13 + p.page * 5) % 256 AS gray FROM (SELECT DISTINCT page FROM boxes) p, range(40) x(i), range(40) y(i)),
dark AS (SELECT * FROM px WHERE gray < 220 AND x >= floor(40 * 0.02) AND x <= floor(40 * (1 - 0.02)) AND y >= floor(40 * 0.02) AND y <= floor(40 * (1 - 0.02))),
small AS (SELECT page, floor(greatest(0.0, l - 0.01) * 40) AS l, floor(greatest(0.0, t - 0.01) * 40) AS t, floor(least(1.0, l + 0.05 + 0.01) * 40) AS r, floor(least(1.0, t + 0.05 + 0.01) * 40) AS b FROM boxes)
SELECT page, round(CAST(count(*) FILTER (NOT EXISTS (SELECT 1 FROM small s WHERE s.page = dark.page AND dark.x BETWEEN s.l AND s.r AND dark.y BETWEEN s.t AND s.b)) AS DOUBLE) / count(*), 6) AS uncovered FROM dark GROUP BY page""")
def uncovered_ink(spark, d):
    boxes = S.embedding_boxes(spark, d)
    b = F.col("box")
    small = boxes.withColumn("box", G.box(b["left"], b["top"], b["left"] + 0.05, b["top"] + 0.05))
    pages = boxes.select("page").distinct().withColumns({"width": F.lit(40), "height": F.lit(40)})
    grid = pages.select("page", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("gray", (F.col("x") * 7 + F.col("y") * 13 + F.col("page") * 5) % 256)
    return quality.uncovered_ink(quality.ink_runs(grid, ["page"]), small, pages, ["page"]).withColumn("uncovered", F.round("uncovered", 6))


# --- usage and cost ------------------------------------------------------------------------------------------------

_LEDGER = """WITH ledger AS (SELECT l_orderkey AS job_id, 'model-' || CAST(l_suppkey % 4 AS VARCHAR) AS model_id, CAST(floor(l_extendedprice) AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS cached_input_tokens, CAST(l_quantity * 10 AS BIGINT) AS output_tokens FROM lineitem),
sums AS (SELECT model_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM ledger GROUP BY model_id)
"""
_PRICED = _LEDGER + f""", prices(model_id, price_in, price_out, price_cached) AS (VALUES {_lit_pairs(PRICES)}),
costed AS (SELECT s.*, CASE WHEN p.model_id IS NULL THEN 0.0 ELSE ((s.input_tokens - least(greatest(cached_input_tokens, 0), greatest(input_tokens, 0))) * CAST(price_in AS DOUBLE) + least(greatest(cached_input_tokens, 0), greatest(input_tokens, 0)) * CAST(coalesce(nullif(price_cached, 0), price_in) AS DOUBLE) + output_tokens * CAST(price_out AS DOUBLE)) / 1e6 END AS cost FROM sums s LEFT JOIN prices p ON s.model_id = p.model_id)
"""


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model_id string, price_in double, price_out double, price_cached double")


@query("usage_by_page", _LEDGER + "SELECT job_id, model_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM ledger GROUP BY job_id, model_id")
def usage_by_page(spark, d):
    return usage.usage_by(S.usage_ledger(spark, d), "job_id", "model_id")


@query("usage_by_model", _LEDGER + "SELECT * FROM sums")
def usage_by_model(spark, d):
    return usage.usage_by(S.usage_ledger(spark, d), "model_id")


@query("usage_total", _LEDGER + "SELECT * FROM sums UNION ALL SELECT 'Total', CAST(sum(input_tokens) AS BIGINT), CAST(sum(cached_input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT) FROM sums")
def usage_total(spark, d):
    return usage.usage_with_total(S.usage_ledger(spark, d))


@query("model_cost", _PRICED + "SELECT model_id, round(cost, 4) AS cost FROM costed")
def model_cost(spark, d):
    return usage.costed(usage.usage_by(S.usage_ledger(spark, d), "model_id"), _catalog(spark)).select("model_id", F.round("cost", 4).alias("cost"))


@query("cost_report", _PRICED + ", r AS (SELECT model_id AS label, cost FROM costed UNION ALL SELECT 'Total', sum(cost) FROM costed) SELECT label, round(cost, 4) AS cost, CASE WHEN cost < 1 THEN printf('$%.6f', cost) ELSE printf('$%.4f', cost) END AS shown FROM r ORDER BY label")
def cost_report(spark, d):
    c = usage.costed(usage.usage_by(S.usage_ledger(spark, d), "model_id"), _catalog(spark)).select(F.col("model_id").alias("label"), "cost")
    total = c.agg(F.sum("cost").alias("cost")).select(F.lit("Total").alias("label"), "cost")
    return c.unionByName(total).select("label", F.round("cost", 4).alias("cost"), X.format_cost(F.col("cost")).alias("shown")).orderBy("label")


@query("first_write_ledger", "SELECT o_custkey AS job_id, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_write_ledger(spark, d):
    return usage.first_writes(S.table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("job_id"), "o_orderkey", "o_totalprice")


@query("batch_summary", """WITH f AS (SELECT o_orderkey AS file_id, 'f' || CAST(o_orderkey AS VARCHAR) AS filename, o_orderkey % 11 = 0 AS bad, CAST(o_orderkey % 9 + 1 AS INTEGER) AS pages, CASE WHEN o_orderkey % 5 <> 0 THEN 'model-' || CAST(o_orderkey % 5 - 1 AS VARCHAR) END AS model FROM orders),
u AS (SELECT l_orderkey AS file_id, sum(floor(l_extendedprice)) * 2.0 / 1e6 AS spent FROM lineitem WHERE l_suppkey % 4 = 0 GROUP BY l_orderkey),
r AS (SELECT f.file_id, filename, CASE WHEN bad THEN 'Failed' ELSE 'Completed' END AS status, CASE WHEN NOT bad THEN pages END AS pages, CASE WHEN NOT bad THEN 'ai' END AS engine, CASE WHEN NOT bad AND model IN ('model-0', 'model-1', 'model-2') THEN coalesce(spent, 0.0) END AS cost, CASE WHEN bad THEN 'broken' ELSE '' END AS error FROM f LEFT JOIN u ON f.file_id = u.file_id)
SELECT file_id, filename, status, pages, engine, round(cost, 6) AS cost, error FROM r UNION ALL SELECT NULL, 'Total', NULL, NULL, NULL, round(sum(cost), 6), NULL FROM r""")
def batch_summary(spark, d):
    k = F.col("o_orderkey")
    o = S.table(spark, d, "orders").select(k.alias("file_id"), F.concat(F.lit("f"), k.cast("string")).alias("filename"), (k % 9 + 1).cast("int").alias("pages"), F.lit("ai").alias("engine"), F.when(k % 5 != 0, F.concat(F.lit("model-"), (k % 5 - 1).cast("string"))).alias("ai_model"), F.when(k % 11 == 0, "broken").alias("error"))
    u = S.usage_ledger(spark, d).where("model_id = 'model-0'").select(F.col("job_id").alias("file_id"), "model_id", "input_tokens", F.lit(0).cast("long").alias("cached_input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    return usage.batch_summary(o, u, _catalog(spark)).withColumn("cost", F.round("cost", 6))


@query("audit_calls", "SELECT 'm' || CAST(user_id % 3 AS VARCHAR) AS model, event_type AS status, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, round(avg(value), 6) AS mean_latency_ms FROM events GROUP BY 1, 2")
def audit_calls(spark, d):
    e = S.table(spark, d, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("status"), (F.col("event_id") % 100).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.col("value").alias("latency_ms"))
    return usage.audit_summary(e).select("model", "status", "calls", "input_tokens", F.round("mean_latency_ms", 6).alias("mean_latency_ms"))


@query("usage_fields", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS input_tokens, CASE WHEN event_id % 3 = 0 THEN event_id % 50 ELSE 0 END AS output_tokens FROM events")
def usage_fields(spark, d):
    raw = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("prompt_tokens"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50).alias("eval_count")))
    return S.table(spark, d, "events").select("event_id", usage.usage_from_json(raw).alias("u")).select("event_id", "u.input_tokens", "u.output_tokens")


_NORMAL = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(65279), ''), '([A-Za-z])-[ \\t]*\\r?\\n[ \\t]*([a-z])', '\\1\\2', 'g'), '([0-9])-[ \\t]*\\r?\\n[ \\t]*([0-9])', '\\1-\\2', 'g'), '[ \\t]*\\r?\\n[ \\t]*', ' ', 'g'), '\\s+', ' ', 'g'))"""


# --- accuracy, calibration, routing --------------------------------------------------------------------------------


@query("char_accuracy", "SELECT a.n_name AS a, b.n_name AS b, round(greatest(0.0, 1 - CAST(levenshtein(a.n_name, b.n_name) AS DOUBLE) / length(b.n_name)), 6) AS accuracy FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def char_accuracy(spark, d):
    n = S.table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", F.round(X.char_accuracy(F.col("a"), F.col("b")), 6).alias("accuracy"))


@query("document_accuracy", f"SELECT doc_id, round(greatest(0.0, 1 - CAST(levenshtein(got, text) AS DOUBLE) / length(text)), 6) AS accuracy FROM (SELECT doc_id, text, {_NORMAL} AS got FROM documents WHERE text <> '')")
def document_accuracy(spark, d):
    """Whole documents against their normalised form."""
    docs = S.table(spark, d, "documents").where("text <> ''")
    return docs.select("doc_id", F.round(distance.text_accuracy(X.normalize_text(F.col("text")), F.col("text")), 6).alias("accuracy"))


_SCORES = "WITH s AS (SELECT doc_id, (doc_id * 37 % 101) / 100.0::DOUBLE AS raw, quality = 1 AS correct FROM labels)\n"


def _scores(spark, d):
    return S.table(spark, d, "labels").select("doc_id", ((F.col("doc_id") * 37) % 101 / F.lit(100.0)).alias("raw"), (F.col("quality") == 1).alias("correct"))


@query("ece", _SCORES + ", g AS (SELECT least(floor(raw * 10), 9) AS b, count(*) AS n, avg(raw) AS c, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS a FROM s WHERE raw BETWEEN 0 AND 1 GROUP BY 1) SELECT round(sum(n * abs(c - a)) / (SELECT count(*) FROM s), 6) AS ece FROM g")
def ece(spark, d):
    return quality.expected_calibration_error(_scores(spark, d), "raw").select(F.round("ece", 6).alias("ece"))


@query("calibrate", _SCORES + "SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN CASE WHEN raw <= 0 THEN 0.1 WHEN raw <= 0.25 THEN 0.1 + raw / 0.25 * 0.1 WHEN raw <= 0.5 THEN 0.2 + (raw - 0.25) / 0.25 * 0.45 WHEN raw <= 1 THEN 0.65 + (raw - 0.5) / 0.5 * 0.25 ELSE 0.9 END WHEN doc_id % 3 = 1 THEN CASE WHEN raw <= 0.1 THEN 0.0 WHEN raw <= 0.9 THEN (raw - 0.1) / 0.8 ELSE 1.0 END END, 6) AS calibrated FROM s")
def calibrate(spark, d):
    pick = lambda a, b: F.when(F.col("doc_id") % 3 == 0, a).when(F.col("doc_id") % 3 == 1, b).otherwise("none")
    s = _scores(spark, d).withColumns({"engine": pick("docling", "ocr"), "model": pick("local", "glm"), "version": pick("1", "2")})
    return quality.confidence_for(s, PROFILES).select("doc_id", F.round("calibrated", 6).alias("calibrated"))


@query("minimum_confidence", _SCORES + "SELECT doc_id, round(least(raw, CASE WHEN doc_id % 2 = 0 THEN 1 - raw END), 6) AS confidence FROM s")
def minimum_confidence(spark, d):
    s = _scores(spark, d)
    return s.select("doc_id", F.round(quality.minimum_confidence(F.col("raw"), F.when(F.col("doc_id") % 2 == 0, 1 - F.col("raw")), F.lit(float("nan")), F.lit(float("inf"))), 6).alias("confidence"))


@query("failed_pages", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def failed_pages(spark, d):
    return quality.failed_pages(S.table(spark, d, "documents").select("doc_id"), S.table(spark, d, "labels"), ["doc_id"])


@query("route_pages", """WITH r AS (SELECT d.doc_id, CASE d.doc_id % 4 WHEN 0 THEN 'docling_ai' WHEN 1 THEN 'pdf_inspector_ai' WHEN 2 THEN 'ai' ELSE 'docling' END AS strategy, CASE WHEN l.doc_id IS NOT NULL THEN (d.doc_id * 37 % 101) / 100.0 END AS c, d.n_chars < 100 AS empty, coalesce(l.quality = 0, false) AS flagged FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, strategy FROM r WHERE CASE strategy WHEN 'docling_ai' THEN c IS NULL OR c < 0.8 OR empty WHEN 'pdf_inspector_ai' THEN c IS NULL OR c < 0.8 OR flagged OR empty ELSE strategy = 'ai' END""")
def route_pages(spark, d):
    s = _scores(spark, d)
    docs = S.table(spark, d, "documents").select("doc_id", "n_chars").join(s, "doc_id", "left")
    m = F.col("doc_id") % 4
    strategy = F.when(m == 0, "docling_ai").when(m == 1, "pdf_inspector_ai").when(m == 2, "ai").otherwise("docling")
    docs = docs.withColumn("strategy", strategy)
    return docs.where(routing.needs_model(F.col("strategy"), F.col("raw"), F.col("n_chars") < 100, F.coalesce(~F.col("correct"), F.lit(False)))).select("doc_id", "strategy")


@query("page_context", _BLOCKS + """SELECT a.doc_id, a.page, coalesce(right(string_agg(right(b.text, 6000), chr(10) || chr(10) ORDER BY b.page), 6000), '') AS before FROM pagetext a LEFT JOIN pagetext b ON a.doc_id = b.doc_id AND b.page < a.page GROUP BY a.doc_id, a.page""")
def page_context(spark, d):
    return routing.with_context(organize.page_texts(_ranged(spark, d))).select("doc_id", "page", "before")


@query("block_types", """WITH t(n, type, block_type, role) AS (VALUES (0, 'chart', 'figure', 'chart'), (1, 'checkbox', 'text', 'checkbox'), (2, 'figure', 'figure', NULL), (3, 'footer', 'marginalia', 'footer'), (4, 'form_field', 'text', 'form_field'), (5, 'header', 'marginalia', 'header'), (6, 'heading', 'text', 'heading'), (7, 'list', 'text', 'list'), (8, 'table', 'table', NULL), (9, 'table_cell', 'text', 'table_cell'), (10, 'text', 'text', NULL), (11, 'title', 'text', 'title'))
SELECT p_partkey, type, block_type, role FROM part JOIN t ON p_partkey % 12 = n""")
def block_types(spark, d):
    kind = F.element_at(F.array(*map(F.lit, sorted(routing.BLOCK_TYPES))), (F.col("p_partkey") % 12 + 1).cast("int"))
    t = S.table(spark, d, "part").select("p_partkey", kind.alias("type")).withColumn("b", routing.block_type(F.col("type")))
    return t.select("p_partkey", "type", F.col("b.type").alias("block_type"), F.col("b.role").alias("role"))


@query("engine_labels", "SELECT l_orderkey AS doc_id, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'hybrid' ELSE min(l_returnflag) END AS engine FROM lineitem GROUP BY l_orderkey")
def engine_labels(spark, d):
    return S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(routing.engine_label(F.collect_set("l_returnflag")).alias("engine"))


@query("region_prompts", """SELECT p_partkey, CASE WHEN contains(v, 'table') THEN 'table' WHEN v = 'chart' THEN 'chart' WHEN v IN ('image', 'seal') THEN 'figure' WHEN contains(v, 'header') THEN 'header' WHEN v = 'doc_title' THEN 'title' ELSE 'text' END AS chunk_type,
 CASE WHEN contains(v, 'table') THEN 'Table Recognition:' WHEN v IN ('chart', 'image', 'seal') THEN 'Figure Recognition:' ELSE 'Text Recognition:' END AS prompt, CASE WHEN contains(v, 'table') THEN 512 WHEN p_size / 1000.0 > 0.03 THEN 256 ELSE 128 END AS token_cap
 FROM (SELECT p_partkey, p_size, list_extract(['text', 'Table_body', 'chart', 'seal', 'page_header', 'doc_title'], CAST(p_partkey % 6 + 1 AS BIGINT)) AS label, lower(list_extract(['text', 'Table_body', 'chart', 'seal', 'page_header', 'doc_title'], CAST(p_partkey % 6 + 1 AS BIGINT))) AS v FROM part)""")
def region_prompts(spark, d):
    label = F.element_at(F.array(*map(F.lit, ["text", "Table_body", "chart", "seal", "page_header", "doc_title"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = S.table(spark, d, "part").withColumn("label", label)
    return p.select("p_partkey", routing.chunk_type(F.col("label")).alias("chunk_type"), routing.ocr_prompt(F.lit("glmocr"), F.col("label")).alias("prompt"), routing.token_cap(F.col("label"), F.col("p_size") / 1000.0).alias("token_cap"))


@query("retryable_calls", "SELECT event_id, (event_id % 700 IN (408, 429) OR event_id % 700 >= 500 OR event_type = 'timeout') AS retry FROM events")
def retryable_calls(spark, d):
    return S.table(spark, d, "events").select("event_id", routing.retryable(F.col("event_id") % 700, F.col("event_type")).alias("retry"))


@query("strategies", "SELECT n_nationkey, CASE WHEN a AND b THEN 'error: one local parser at most' WHEN l AND (a OR b OR m) THEN 'error: a local model stands alone' WHEN l THEN 'ollama' WHEN a AND m THEN 'docling_ai' WHEN b AND m THEN 'pdf_inspector_ai' WHEN a THEN 'docling' WHEN b THEN 'pdf_inspector' WHEN m THEN 'ai' ELSE 'error: no engine' END AS strategy FROM (SELECT n_nationkey, n_nationkey % 2 = 1 AS a, n_nationkey // 2 % 2 = 1 AS b, n_nationkey // 4 % 2 = 1 AS m, n_nationkey // 8 % 2 = 1 AS l FROM nation)")
def strategies(spark, d):
    bit = lambda k: F.expr(f"(n_nationkey div {k}) % 2 = 1")
    return S.table(spark, d, "nation").select("n_nationkey", routing.strategy_for(bit(1), bit(2), bit(4), bit(8)).alias("strategy"))


@query("scan_like_pages", "SELECT page_id, NOT ends_with(lower(url), '.html') OR page_id % 5 = 0 AS scan_like FROM pages")
def scan_like_pages(spark, d):
    name = F.regexp_replace(F.lower("url"), r"\.html$", ".pdf")
    return S.table(spark, d, "pages").select("page_id", routing.scan_like(name, F.when(F.col("page_id") % 5 != 0, 3)).alias("scan_like"))


# --- admission, batches, jobs --------------------------------------------------------------------------------------


@query("page_range_select", "WITH c AS (SELECT conv_id AS doc_id, CAST(max(turn) + 1 AS INTEGER) AS n FROM conversations GROUP BY conv_id), r AS (SELECT doc_id, n, CAST(1 + doc_id % 3 AS INTEGER) AS a, CASE WHEN doc_id % 4 = 0 THEN n ELSE 4 END AS z FROM c) SELECT doc_id, CAST(unnest(range(a, z + 1)) AS INTEGER) AS page FROM r WHERE a <= z AND z <= n")
def page_range_select(spark, d):
    c = S.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg((F.max("turn") + 1).cast("int").alias("page_count"))
    return batch.selected_pages(c.withColumns({"first_page": (1 + F.col("doc_id") % 3).cast("int"), "last_page": F.when(F.col("doc_id") % 4 != 0, 4)}))


@query("page_range_errors", "WITH c AS (SELECT conv_id AS doc_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id) SELECT doc_id, 'invalid_page_range' AS error FROM c WHERE 1 + doc_id % 3 > 4 OR 4 > n")
def page_range_errors(spark, d):
    c = S.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg((F.max("turn") + 1).alias("n"))
    return c.select("doc_id", assemble.page_range_violation(1 + F.col("doc_id") % 3, F.lit(4), F.col("n")).alias("error")).where("error is not null")


@query("admission", """WITH f AS (SELECT doc_id, list_extract(['pdf', 'png', 'JPG', 'tiff', 'docx', 'exe', 'csv'], CAST(doc_id % 7 + 1 AS BIGINT)) AS e0, n_chars AS size, doc_id % 23 AS page_count, doc_id % 29 = 0 AS encrypted, n_chars * 10000 AS pixels FROM documents),
g AS (SELECT *, lower(e0) AS e FROM f),
h AS (SELECT *, CASE WHEN size > 5000 THEN 'too_large' WHEN e = 'pdf' AND encrypted THEN 'encrypted_pdf' WHEN e = 'pdf' AND page_count < 1 THEN 'empty_document' WHEN e IN ('pdf', 'png', 'jpg', 'tiff') AND page_count > 20 THEN 'too_many_pages' WHEN e = 'exe' THEN 'unsupported_type' WHEN e IN ('png', 'jpg', 'tiff') AND pixels > 40000000 THEN 'image_too_large' END AS error FROM g)
SELECT doc_id, error, CASE WHEN error IS NULL THEN CASE e WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'tiff' THEN 'image/tiff' WHEN 'csv' THEN 'text/csv' ELSE 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END END AS mime_type, CASE WHEN error IS NULL THEN CASE WHEN e IN ('docx', 'csv') THEN 1 ELSE page_count END END AS pages FROM h""")
def admission(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ["pdf", "png", "JPG", "tiff", "docx", "exe", "csv"])), (F.col("doc_id") % 7 + 1).cast("int"))
    f = S.table(spark, d, "documents").select("doc_id", F.concat(F.lit("a.b/file."), ext).alias("filename"), F.col("n_chars").alias("size"), (F.col("doc_id") % 23).alias("page_count"), (F.col("doc_id") % 29 == 0).alias("encrypted"), (F.col("n_chars") * 10000).alias("pixels"))
    return batch.admitted(f, most_bytes=5000, most_pages=20).select("doc_id", "error", "mime_type", "pages")


def _be32(n):
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def _le32(n):
    n = n.cast("long")
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))


def _raw(text: str):
    return F.unhex(F.lit(text))


def _made_files(spark, d):
    """A file of each document, its text behind a header: pictures as large as the text is long, directories of frames, page trees; some broken, some encrypted."""
    k, n = F.col("doc_id"), F.col("n_chars")
    ihdr = F.concat(F.encode(F.lit("IHDR"), "utf-8"), _be32(100 + n), _be32(F.lit(2000)), _raw("0806000000"))
    png = F.concat(_raw("89504E470D0A1A0A0000000D"), ihdr, _be32(F.crc32(ihdr) + F.when(k % 11 == 0, 1).otherwise(0)), _raw("0000000049454E44AE426082"))
    directory = lambda i: F.concat(_raw("0200"), _raw("0001040001000000"), _le32(F.lit(1000)), _raw("0101040001000000"), _le32(F.lit(1500)), F.when(i + 1 < k % 30, _le32(8 + 30 * (i + 1))).otherwise(_raw("00000000")))
    frames = F.transform(F.sequence(F.lit(0).cast("long"), k % 30), lambda i: F.hex(F.when(i < k % 30, directory(i)).otherwise(_raw(""))))
    tiff = F.concat(_raw("49492A00"), F.when(k % 30 == 0, _raw("00000000")).otherwise(_raw("08000000")), F.unhex(F.array_join(frames, "")))
    bmp = F.concat(_raw("424D" + "00" * 12 + "28000000"), _le32(n * 4), _le32(F.lit(2500)), _raw("00" * 28))
    jpeg = F.concat(_raw("FFD8FFE000040000FFC0000B08"), F.unhex(F.lpad(F.hex(F.lit(9000)), 4, "0")), F.unhex(F.lpad(F.hex(F.least(n, F.lit(60000)).cast("long")), 4, "0")), _raw("0101110000FFD9"))
    pages = F.filter(F.sequence(F.lit(0).cast("long"), k % 25), lambda i: i < k % 25)
    kids = F.array_join(F.transform(pages, lambda i: F.concat((i + 3).cast("string"), F.lit(" 0 R"))), " ")
    leaves = F.array_join(F.transform(pages, lambda i: F.concat((i + 3).cast("string"), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n"))), "")
    body = F.concat(
        F.when(k % 31 == 0, "%TXT").otherwise("%PDF-1.4"), F.lit("\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /MediaBox [0 0 "), (600 + n).cast("string"), F.lit(" 800] /Kids ["), kids, F.lit("] >>\nendobj\n"), leaves,
        F.lit("trailer\n<< /Root 1 0 R"), F.when(k % 29 == 0, " /Encrypt 9 0 R").otherwise(""), F.lit(" >>\nstartxref\n0\n%%EOF\n"),
    )
    kind = (k % 7).cast("int")
    ext = F.element_at(F.array(*map(F.lit, ["pdf", "png", "JPG", "tiff", "bmp", "exe", "csv"])), kind + 1)
    head = F.when(kind == 0, F.encode(body, "utf-8")).when(kind == 1, png).when(kind == 2, jpeg).when(kind == 3, tiff).when(kind == 4, bmp).otherwise(_raw(""))
    return S.table(spark, d, "documents").where("doc_id is not null and text is not null").select("doc_id", F.concat(F.lit("a.b/file."), ext).alias("filename"), F.octet_length("text").alias("size"), F.concat(head, F.encode("text", "utf-8")).alias("content"))


@query("admission_from_bytes", """WITH f AS (SELECT doc_id AS k, n_chars AS n, octet_length(encode(text)) AS size, doc_id % 7 AS e FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, CASE e WHEN 0 THEN k % 25 WHEN 3 THEN k % 30 ELSE 1 END AS pages, CASE e WHEN 1 THEN (100 + n) * 2000 WHEN 2 THEN least(n, 60000) * 9000 WHEN 3 THEN (k % 30) * 1500000 WHEN 4 THEN n * 4 * 2500 END AS pixels FROM f),
h AS (SELECT *, CASE WHEN size > 20000 THEN 'too_large' WHEN e = 0 AND k % 31 = 0 THEN 'invalid_pdf' WHEN e = 0 AND k % 29 = 0 THEN 'encrypted_pdf' WHEN e = 0 AND pages = 0 THEN 'empty_document' WHEN e = 0 AND (600 + n) * 800 > 4000000 THEN 'canvas_too_large'
  WHEN e IN (0, 3) AND pages > 20 THEN 'too_many_pages' WHEN e = 5 THEN 'unsupported_type' WHEN e = 1 AND k % 11 = 0 OR e = 3 AND k % 30 = 0 THEN 'invalid_image' WHEN e BETWEEN 1 AND 4 AND pixels > 40000000 THEN 'image_too_large' END AS error FROM g)
SELECT k AS doc_id, error, CASE WHEN error IS NULL THEN list_extract(['application/pdf', 'image/png', 'image/jpeg', 'image/tiff', 'image/bmp', NULL, 'text/csv'], CAST(e + 1 AS BIGINT)) END AS mime_type, CASE WHEN error IS NULL THEN CAST(pages AS INTEGER) END AS pages FROM h""")
def admission_from_bytes(spark, d):
    return batch.admitted(headers.inspected(_made_files(spark, d)), most_bytes=20_000, most_pages=20).select("doc_id", "error", "mime_type", "pages")


#: What the properties of an event may be, for the registered query: an object with a small number, and more.
PROPS_SCHEMA = {
    "type": "object", "required": ["k"], "additionalProperties": False,
    "properties": {
        "k": {"type": "integer", "minimum": 0, "maximum": 80},
        "list": {"type": "array", "maxItems": 3, "items": {"type": ["integer", "null"]}},
        "box": {"type": "object", "required": ["left"], "properties": {"left": {"type": "number", "exclusiveMaximum": 1}, "role": {"enum": ["title", "text"]}}},
    },
}


@query("schema_violations", """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id % 9 AS m FROM events)
SELECT event_id, CASE m WHEN 1 THEN '$.k: type' WHEN 2 THEN '$: required k' WHEN 3 THEN '$: type' WHEN 8 THEN '$: JSON' ELSE CASE WHEN k > 80 THEN '$.k: maximum' ELSE CASE m WHEN 4 THEN '$.list[2]: type' WHEN 5 THEN '$.extra: additionalProperties' WHEN 6 THEN '$.box: required left' WHEN 7 THEN '$.box.role: enum' END END END AS violation FROM e""")
def schema_violations(spark, d):
    """Properties of events, eight of nine of which are broken in one way or another."""
    k = F.get_json_object("props", "$.k")
    broken = ['{"k": "KK"}', '{"list": [1]}', "[1, 2]", '{"k": KK, "list": [1, null, "x"]}', '{"k": KK, "extra": true}', '{"k": KK, "box": {"role": "text"}}', '{"k": KK, "box": {"left": 0.5, "role": "table"}}', '{"k": ']
    text = F.col("props")
    for i, b in enumerate(broken, 1):
        text = F.when(F.col("event_id") % 9 == i, F.replace(F.lit(b), F.lit("KK"), k)).otherwise(text)
    return S.table(spark, d, "events").select("event_id", schema.violation(F.try_parse_json(text), PROPS_SCHEMA).alias("violation"))


def _nested(spark, d):
    """Drafts as JSON whose boxes lie one to six levels deep, in thousandths, in shares, or out of order."""
    m = F.col("vec_id") % 4
    side = lambda name, k, n: F.concat(F.lit(f'"{name}":'), F.when(m == 0, F.lit(str(n))).when(m == 1, F.lit(str(n / 1000))).when(m == 2, F.lit(str(n * 2))).otherwise(F.lit(str(k))))
    box = F.concat(F.lit("{"), F.array_join(F.array(side("left", 900, 125), side("top", 100, 250), side("right", 300, 500), side("bottom", 200, 375)), ","), F.lit("}"))
    depth = F.expr("cast(vec_id div 4 % 6 as int)")
    inner = F.aggregate(F.filter(F.sequence(F.lit(0), depth), lambda i: i < depth), box, lambda s, i: F.when(i % 2 == 0, F.concat(F.lit('{"n":1,"in":'), s, F.lit("}"))).otherwise(F.concat(F.lit("[2,"), s, F.lit("]"))))
    text = F.concat(F.lit('{"chunks":[{"text":"item '), F.col("vec_id").cast("string"), F.lit('","a":'), inner, F.lit('},{"markdown":"own","row":3}]}'))
    return S.table(spark, d, "embeddings").select("vec_id", F.parse_json(text).alias("v"))


@query("nested_normalization", """WITH e AS (SELECT vec_id, vec_id % 4 AS m FROM embeddings),
s AS (SELECT *, CASE m WHEN 3 THEN 0.9 WHEN 2 THEN 0.25 ELSE 0.125 END AS l, CASE m WHEN 3 THEN 0.2 WHEN 2 THEN 0.75 ELSE 0.375 END AS b FROM e)
SELECT vec_id, CAST(l AS DOUBLE) AS l, CAST(b AS DOUBLE) AS b, 'item ' || CAST(vec_id AS VARCHAR) AS markdown, 'own' AS other, 3 AS row, '[]' AS lines FROM s""")
def nested_normalization(spark, d):
    tree = trees.normalized(trees.nodes(_nested(spark, d), ["vec_id"], "v"), ["vec_id"])
    out = trees.rebuilt(tree, ["vec_id"])
    number = lambda name: F.regexp_extract("json", f'"{name}":([0-9.]+)', 1).cast("double")
    get = lambda path: F.get_json_object("json", path)
    return out.select("vec_id", number("left").alias("l"), number("bottom").alias("b"), get("$.chunks[0].markdown").alias("markdown"), get("$.chunks[1].markdown").alias("other"), get("$.chunks[1].row").cast("int").alias("row"), get("$.chunks[1].atomic_lines").alias("lines"))


@query("nested_geometry", """SELECT vec_id, '$.chunks[0].a' || list_extract(['', '.in', '[1].in', '.in[1].in', '[1].in[1].in', '.in[1].in[1].in'], CAST(vec_id // 4 % 6 + 1 AS BIGINT)) || ' must have left < right and top < bottom' AS error FROM embeddings WHERE vec_id % 4 = 3""")
def nested_geometry(spark, d):
    return trees.geometry_errors(trees.nodes(_nested(spark, d), ["vec_id"], "v"), ["vec_id"])


@query("file_id", "SELECT doc_id, CAST(doc_id % 20 AS VARCHAR) || '-' || substr(sha256(encode('file' || CAST(doc_id AS VARCHAR) || '.txt') || '\\x00'::BLOB || encode(text)), 1, 16) AS file_id FROM documents WHERE text IS NOT NULL")
def file_id(spark, d):
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", batch.file_id(F.col("doc_id") % 20, F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.lit(".txt")), F.encode("text", "utf-8")).alias("file_id"))


@query("content_sha256", "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def content_sha256(spark, d):
    found = S.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "utf-8").alias("content"))
    return files.hashes(found).withColumnRenamed("path", "doc_id")


@query("preflight", """WITH f AS (SELECT l_orderkey AS batch_id, 'f' || CAST(l_linenumber AS VARCHAR) || CASE WHEN l_orderkey % 2 = 0 THEN '.pdf' ELSE '.png' END AS filename, CAST(round(l_extendedprice * 5000) AS BIGINT) AS size, CASE WHEN l_quantity > 48 THEN 'too_large' END AS error FROM lineitem),
b AS (SELECT o_orderkey AS batch_id, CASE WHEN o_orderkey % 13 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'ollama' ELSE 'cloud' END END AS engine, list_extract(['ai', 'pdf_inspector_ai', 'docling'], CAST(o_orderkey % 3 + 1 AS BIGINT)) AS strategy, o_orderkey % 7 <> 0 AS has_key, o_orderkey % 5 <> 0 AS ready FROM orders),
g AS (SELECT batch_id, count(*) AS n, sum(size) AS bytes FROM f GROUP BY batch_id), t AS (SELECT b.*, n, bytes FROM b LEFT JOIN g USING (batch_id))
SELECT batch_id, 'Choose one processing engine.' AS message FROM t WHERE engine IS NULL UNION ALL SELECT batch_id, 'Choose no more than 20 files.' FROM t WHERE n > 20 UNION ALL SELECT batch_id, 'Combined upload size exceeds 1 GiB.' FROM t WHERE bytes > 1073741824
UNION ALL SELECT batch_id, 'PDF Inspector strategies accept PDF files only.' FROM t WHERE strategy = 'pdf_inspector_ai' AND n > 0 AND batch_id % 2 = 1 UNION ALL SELECT batch_id, 'A_KEY is required.' FROM t WHERE engine IS NOT NULL AND strategy <> 'docling' AND NOT has_key
UNION ALL SELECT batch_id, 'Choose a vision-capable Ollama model.' FROM t WHERE engine = 'ollama' AND NOT ready UNION ALL SELECT batch_id, filename || ': too_large' FROM f WHERE error IS NOT NULL""")
def preflight(spark, d):
    k = F.col("o_orderkey")
    b = S.table(spark, d, "orders").select(k.alias("batch_id"), F.when(k % 13 != 0, F.when(k % 4 == 0, "ollama").otherwise("cloud")).alias("engine"), F.element_at(F.array(*map(F.lit, ["ai", "pdf_inspector_ai", "docling"])), (k % 3 + 1).cast("int")).alias("strategy"), F.lit("A_KEY").alias("key_name"), (k % 7 != 0).alias("has_key"), (k % 5 != 0).alias("local_ready"))
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.when(F.col("l_orderkey") % 2 == 0, ".pdf").otherwise(".png"))
    f = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), name.alias("filename"), F.round(F.col("l_extendedprice") * 5000).cast("long").alias("size"), F.when(F.col("l_quantity") > 48, "too_large").alias("error"))
    return batch.preflight(b, f)


@query("artifact_names", "WITH a AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '..' WHEN page_id % 8 = 0 THEN url || '//' ELSE url END AS name FROM pages), l AS (SELECT page_id, regexp_extract(regexp_replace(name, '/+$', ''), '([^/]*)$', 1) AS leaf FROM a) SELECT page_id, CASE WHEN leaf NOT IN ('', '.', '..') THEN leaf END AS leaf, CASE WHEN leaf IN ('', '.', '..') THEN 'Artifact name must be a file name' END AS error FROM l")
def artifact_names(spark, d):
    name = F.when(F.col("page_id") % 9 == 0, "..").when(F.col("page_id") % 8 == 0, F.concat("url", F.lit("//"))).otherwise(F.col("url"))
    return jobs.artifact_names(S.table(spark, d, "pages").select(F.col("page_id").alias("job_id"), name.alias("name"))).select(F.col("job_id").alias("page_id"), "leaf", "error")


@query("new_jobs", "SELECT o_orderkey AS job_id, 'pending' AS status, o_orderdate AS created_at FROM orders")
def new_jobs(spark, d):
    log = jobs.created(S.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("at"), F.lit("ai").alias("engine")))
    return jobs.job_state(log).select("job_id", "status", "created_at")


@query("cache_shard", "SELECT doc_id, CAST(CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 4 AS INTEGER) AS shard FROM documents WHERE text IS NOT NULL")
def cache_shard(spark, d):
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", routing.cache_shard(F.sha2("text", 256)).alias("shard"))


@query("batch_limits", "SELECT l_orderkey AS batch_id, count(*) AS files, CAST(sum(CAST(l_extendedprice * 5000 AS BIGINT)) AS BIGINT) AS bytes, CASE WHEN count(*) > 20 THEN 'too many files' ELSE 'too many bytes' END AS violation FROM lineitem GROUP BY l_orderkey HAVING count(*) > 20 OR sum(CAST(l_extendedprice * 5000 AS BIGINT)) > 1073741824")
def batch_limits(spark, d):
    f = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.round(F.col("l_extendedprice") * 5000).cast("long").alias("size"))
    return batch.batch_violations(f)


@query("batch_outcomes", "SELECT o_orderkey AS file_id, CASE WHEN l.n IS NULL OR o_orderkey % 13 = 0 THEN 'failed' ELSE 'completed' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey) l ON o_orderkey = l_orderkey")
def batch_outcomes(spark, d):
    r = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderkey").alias("seq"))
    done = S.table(spark, d, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.count(F.lit(1)).alias("result")).withColumn("error", F.when(F.col("file_id") % 13 == 0, "x"))
    return batch.outcomes(r, done).select("file_id", "status")


@query("corpus_integrity", "SELECT doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'differs' ELSE 'verified' END AS state FROM documents")
def corpus_integrity(spark, d):
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("n_chars").alias("size"))
    actual = docs.where("path % 9 <> 0").withColumn("sha256", F.when(F.col("path") % 10 == 0, "0").otherwise(F.col("sha256")))
    return batch.integrity(docs, actual).select("path", "state")


_LOG = """WITH log AS (SELECT event_id // 10 AS job_id, event_id AS seq, ts AS moment, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'checkpoint' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS event, value, props FROM events),
state AS (SELECT job_id, arg_max(event, seq) FILTER (event <> 'checkpoint') AS status, arg_max(CASE WHEN event = 'failed' THEN props ELSE '' END, seq) FILTER (event <> 'checkpoint') AS error, arg_max(value, seq) FILTER (event = 'completed') AS result, max(seq) FILTER (event = 'checkpoint') AS checkpoint, min(moment) AS created_at, max(moment) AS updated_at FROM log GROUP BY job_id)
"""


@query("job_state", _LOG + "SELECT job_id, status, nullif(error, '') AS error, result, checkpoint FROM state")
def job_state(spark, d):
    return jobs.job_state(S.job_log(spark, d)).select("job_id", "status", "error", "result", "checkpoint")


@query("job_purge", _LOG + f"SELECT job_id FROM state WHERE updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY")
def job_purge(spark, d):
    return jobs.kept_after_purge(jobs.job_state(S.job_log(spark, d)), AS_OF, 20).select("job_id")


@query("recoverable_jobs", _LOG + "SELECT job_id, status FROM state WHERE status IN ('pending', 'running')")
def recoverable_jobs(spark, d):
    return jobs.recoverable(jobs.job_state(S.job_log(spark, d))).select("job_id", "status")


@query("job_list", _LOG + "SELECT job_id, status FROM state ORDER BY created_at DESC, job_id")
def job_list(spark, d):
    return jobs.newest_first(jobs.job_state(S.job_log(spark, d))).select("job_id", "status")


@query("job_grid", "SELECT conv_id AS job_id, CAST(1 + conv_id % 3 AS VARCHAR) || '-' || CASE WHEN conv_id % 2 = 0 THEN 'end' ELSE CAST(max(turn) + 1 AS VARCHAR) END AS pages FROM conversations GROUP BY conv_id")
def job_grid(spark, d):
    c = S.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("job_id")).agg((F.max("turn") + 1).alias("n"))
    return c.select("job_id", jobs.grid(1 + F.col("job_id") % 3, F.when(F.col("job_id") % 2 != 0, F.col("n"))).alias("pages"))


@query("rejected_runs", _LOG + "SELECT c.c_custkey AS job_id, 'unknown job' AS reason FROM customer c LEFT JOIN state s ON c.c_custkey = s.job_id WHERE s.job_id IS NULL")
def rejected_runs(spark, d):
    return jobs.rejected_runs(jobs.job_state(S.job_log(spark, d)), S.table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"))).select("job_id", "reason")


def _pieces(spark, log, *by):
    """The log as a folder of several files, for a stream that takes one at a time."""
    folder = shared_folder(spark, "log")
    log.repartition(4, *by).write.parquet(folder)
    return folder


@query("streamed_jobs", _LOG + "SELECT job_id, status, nullif(error, '') AS error, result, checkpoint, created_at, updated_at FROM state")
def streamed_jobs(spark, d):
    """The log in four pieces, each of which has events of all jobs, as a stream into the keyed store."""
    log = S.job_log(spark, d)
    return store.latest(store.replayed(spark, _pieces(spark, log, F.col("seq") % 4), guarded=False))


@query("refused_runs", _LOG + """, known AS (SELECT job_id, coalesce(min(seq) FILTER (event <> 'running'), 9223372036854775807) AS k, FROM log GROUP BY job_id)
SELECT l.job_id, seq, 'Unknown job' AS reason FROM log l JOIN known USING (job_id) WHERE event = 'running' AND seq < k""")
def refused_runs(spark, d):
    """Runs that the guarded store refuses: those of jobs that nothing has created yet. A job's events come in one piece."""
    rows = store.replayed(spark, _pieces(spark, S.job_log(spark, d), "job_id"))
    return rows.where("kind = 'refused'").select("job_id", "seq", "reason")


@query("failure_streaks", """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS island FROM events)
SELECT user_id, count(*) AS length, min(event_id) AS first, max(event_id) AS last FROM e WHERE f GROUP BY user_id, island HAVING count(*) >= 3""")
def failure_streaks(spark, d):
    return quality.failure_streaks(S.table(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error")


@query("progress", """WITH e AS (SELECT event_id // 10 AS job_id, event_id, event_id % 10 + 1 AS done FROM events)
SELECT job_id, event_id, CAST(max(5 + round_even(85.0 * done / 10, 0)) OVER (PARTITION BY job_id ORDER BY event_id) AS INTEGER) AS percent FROM e""")
def progress(spark, d):
    e = S.table(spark, d, "events").select(F.expr("event_id div 10").alias("job_id"), "event_id", (F.col("event_id") % 10 + 1).alias("done"))
    return batch.progress(e, ["job_id"], ["event_id"], F.col("done"), F.lit(10)).select("job_id", "event_id", "percent")


@query("batch_progress", """WITH e AS (SELECT event_id // 10 AS job_id, event_id, least(event_id % 10 * 2, 10) AS done, event_id % 10 // 2 AS files FROM events)
SELECT job_id, event_id, CAST(max(CASE WHEN done >= 10 THEN 90 + round_even(9.0 * files / 4, 0) ELSE 5 + round_even(85.0 * done / 10, 0) END) OVER (PARTITION BY job_id ORDER BY event_id) AS INTEGER) AS percent FROM e""")
def batch_progress(spark, d):
    """Pages first, then files once all pages are done."""
    n = F.col("event_id") % 10
    e = S.table(spark, d, "events").select(F.expr("event_id div 10").alias("job_id"), "event_id", F.least(n * 2, F.lit(10)).alias("done"), F.floor(n / 2).alias("files"))
    return batch.progress(e, ["job_id"], ["event_id"], F.col("done"), F.lit(10), F.col("files"), F.lit(4)).select("job_id", "event_id", "percent")


@query("batch_workers", "SELECT l_orderkey AS batch_id, CAST(least(greatest(count(*), 1), 6) AS INTEGER) AS workers FROM lineitem GROUP BY l_orderkey")
def batch_workers(spark, d):
    g = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return g.select("batch_id", batch.workers(F.col("n")).alias("workers"))


@query("source_warnings", f"""WITH e AS (SELECT DISTINCT user_id AS doc_id FROM events), f AS (SELECT user_id AS doc_id, CASE WHEN event_type <> 'view' THEN event_type ELSE ' ' END AS t FROM events)
SELECT doc_id, '{ingest.ENCODING_WARNING.replace("'", "''")}' AS warning FROM e WHERE doc_id % 3 = 0 UNION ALL SELECT DISTINCT doc_id, '{ingest.FIGURE_WARNING.replace("'", "''")}' FROM f WHERE t = ' '""")
def source_warnings(spark, d):
    e = S.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ").alias("description"))
    return ingest.source_warnings(e.select("doc_id", (F.col("doc_id") % 3 == 0).alias("broken_encoding")), e)


@query("unordered_pages", "SELECT DISTINCT doc_id FROM (SELECT l_orderkey AS doc_id, l_partkey % 50 AS page, lag(l_partkey % 50) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) WHERE b > page")
def unordered_pages(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    p = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("page_seq"), (F.col("l_partkey") % 50).alias("page"))
    return assemble.unordered_pages(p)


@query("ocr_warnings", "SELECT user_id AS doc_id, 'PDF Inspector cannot OCR pages: ' || string_agg(CAST(p AS VARCHAR), ', ' ORDER BY p) AS warning FROM (SELECT DISTINCT user_id, event_id % 7 + 1 AS p FROM events WHERE event_type = 'error') GROUP BY user_id")
def ocr_warnings(spark, d):
    e = S.table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7 + 1).alias("page"))
    return quality.warning_list(e, ["doc_id"])


# --- text ----------------------------------------------------------------------------------------------------------


@query("normalize_text", f"SELECT doc_id, {_NORMAL} AS text FROM documents")
def normalize_text(spark, d):
    return S.table(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("text"))


@query("normalized_key", f"SELECT doc_id, sha256(replace(lower({_NORMAL}), 'ß', 'ss')) AS key FROM documents")
def normalized_key(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.sha2(X.normalized_key(F.col("text")), 256).alias("key"))


@query("emails", "SELECT doc_id, lower(rtrim(unnest(list_distinct(regexp_extract_all(text, '(?i)[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{2,}'))), '.,;:')) AS email FROM documents")
def emails(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}"), F.lit(0))
    return S.table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("e")).select("doc_id", F.lower(F.regexp_replace("e", r"[.,;:]+$", "")).alias("email"))


@query("critical_tokens")
def critical_tokens(spark, d):
    return S.table(spark, d, "documents").select("doc_id", X.critical_tokens(F.col("text")).alias("tokens")).where("size(tokens) > 0").select("doc_id", F.array_join("tokens", "|").alias("tokens"))


@query("precision_pages")
def precision_pages(spark, d):
    return S.table(spark, d, "documents").select("doc_id", X.needs_precision(F.lit("text"), F.col("text")).alias("precise"))


@query("consecutive_dedup", """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS ord FROM documents WHERE text IS NOT NULL)
SELECT doc_id, ord, line FROM (SELECT *, lag(line) OVER w AS b, row_number() OVER w AS rn FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) WHERE rn = 1 OR b IS DISTINCT FROM line""")
def consecutive_dedup(spark, d):
    return quality.consecutive_distinct(S.document_lines(spark, d), ["doc_id"], "ord", "line")


_BAG = "WITH t AS (SELECT doc_id AS id, 'd' AS side, {0} AS text FROM documents UNION ALL SELECT item_id, 'b', {0} FROM benchmark), w AS (SELECT id, side, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM t)"


@query("token_overlap", _BAG.format(_NORMAL) + """, c AS (SELECT id, side, word, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT id, side, sum(n) AS n FROM c GROUP BY ALL),
m AS (SELECT x.id AS doc_id, y.id AS item_id, sum(least(x.n, y.n)) AS common FROM c x JOIN c y ON x.word = y.word AND x.side = 'd' AND y.side = 'b' GROUP BY 1, 2)
SELECT doc_id, item_id, round(CAST(common AS DOUBLE) / least(a.n, b.n), 6) AS recall FROM m JOIN s a ON a.id = doc_id AND a.side = 'd' JOIN s b ON b.id = item_id AND b.side = 'b' WHERE a.n >= 5 AND b.n >= 5 AND common >= 0.8 * least(a.n, b.n)""")
def token_overlap(spark, d):
    docs, items = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), S.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return quality.token_overlap(docs, items).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), F.round("recall", 6).alias("recall"))


@query("safe_stem", """WITH s AS (SELECT page_id, regexp_replace(url, '^.*/', '') AS leaf FROM pages), b AS (SELECT page_id, CASE WHEN contains(leaf, '.') THEN regexp_extract(leaf, '^(.*)\\.[^.]*$', 1) ELSE leaf END AS base FROM s),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(base, '[^A-Za-z0-9._-]+', '-', 'g'), '^[ ._-]+', ''), '[ ._-]+$', '') AS stem FROM b)
SELECT page_id, coalesce(nullif(substr(stem, 1, 80), ''), 'document') AS stem FROM t""")
def safe_stem(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.safe_stem(F.col("url")).alias("stem"))


_UNESCAPED = "regexp_replace(replace(replace(replace({0}, '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;?', '&', 'g')"


@query("plain_excerpt", "SELECT page_id, substr(trim(regexp_replace(" + _UNESCAPED.format("regexp_replace(html, '<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g')), 1, 360) AS excerpt FROM pages")
def plain_excerpt(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.plain_excerpt(F.col("html")).alias("excerpt"))


@query("sanitize_html")
def sanitize_html(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.sanitize_html("html").alias("html"))


@query("standalone_html")
def standalone_html(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.standalone_html(F.col("url"), X.sanitize_html("html")).alias("html"))


_PART_HTML = "'<h1>' || p_name || '</h1>' || chr(10) || '<p>A <strong>' || p_brand || '</strong> of <em>' || p_type || '</em> at <code>' || CAST(p_size AS VARCHAR) || '</code>.</p>' || chr(10) || '<ul>' || chr(10) || '<li>' || p_brand || '</li>' || chr(10) || '<li>no ' || CAST(p_partkey AS VARCHAR) || '</li>' || chr(10) || '</ul>' || chr(10) || '{0}'"
_PART_TABLE = "<table>' || chr(10) || '<thead>' || chr(10) || '<tr>' || chr(10) || '<th>Key</th>' || chr(10) || '<th>Size</th>' || chr(10) || '</tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || '<tr>' || chr(10) || '<td>' || CAST(p_partkey AS VARCHAR) || '</td>' || chr(10) || '<td>' || CAST(p_size AS VARCHAR) || '</td>' || chr(10) || '</tr>' || chr(10) || '</tbody>' || chr(10) || '</table>"


@query("rendered_markdown", "SELECT p_partkey, " + _PART_HTML.format(_PART_TABLE) + " AS html FROM part")
def rendered_markdown(spark, d):
    """A page on each part, with a heading, emphasis, code, a list and a table."""
    one = F.format_string("# %s\n\nA **%s** of *%s* at `%d`.\n\n- %s\n- no %d\n\n| Key | Size |\n| --- | ---: |\n| %d | %d |\n", "p_name", "p_brand", "p_type", "p_size", "p_brand", "p_partkey", "p_partkey", "p_size")
    return S.table(spark, d, "part").select("p_partkey", markdown.markdown_html(one).alias("html"))


@query("latin1_text", "SELECT doc_id, regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') AS text FROM documents")
def latin1_text(spark, d):
    return S.table(spark, d, "documents").select("doc_id", X.latin1(F.col("text")).alias("text"))


@query("report_lines")
def report_lines(spark, d):
    """A report on each conversation: its turns are the source pages."""
    w = Window.partitionBy("doc_id").orderBy("page", "ord")
    e = S.conversation_blocks(spark, d).select("doc_id", F.row_number().over(w).alias("seq"), F.col("page").alias("source_page"), X.unescape(X.plain_excerpt(F.col("markdown"))).alias("excerpt"))
    return align.report_lines(e, ["doc_id"])


@query("class_names", "SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents")
def class_names(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.size(X.class_names(F.col("text"))).cast("long").alias("n"))


@query("line_blocks", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents")
def line_blocks(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.size(X.split_lines(F.col("text"))).cast("long").alias("n"))


_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query("figure_markup", "SELECT doc_id, '<figure type=\"chart\"><description>' || " + _ESCAPED.format("trim(text)") + " || '</description>' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || lang WHEN doc_id % 3 = 1 THEN chr(10) || 'A caption' ELSE '' END || '</figure>' AS markup FROM documents WHERE text IS NOT NULL")
def figure_markup(spark, d):
    m = F.col("doc_id") % 3
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", X.figure_markup(F.lit("chart"), F.col("text"), F.when(m == 0, F.col("lang")), F.when(m == 1, "A caption")).alias("markup"))


_VISUAL = "CASE doc_id % 5 WHEN 0 THEN '<figure type=\"figure\"><description>' || text || '</description></figure>' WHEN 1 THEN ' <FIGURE><Description>' || text || '</DESCRIPTION>' || chr(10) || '</figure> ' WHEN 2 THEN '<figure>' || text || '</figure>' WHEN 3 THEN '<figure><description>' || text ELSE text END"


@query("semantic_visuals", "SELECT doc_id, v LIKE '<figure%' AND v LIKE '%<description>%' AND v LIKE '%</description>%' AND v LIKE '%</figure>' AS semantic FROM (SELECT doc_id, lower(trim(regexp_replace(" + _VISUAL + ", '\\s+', ' ', 'g'))) AS v FROM documents WHERE text IS NOT NULL)")
def semantic_visuals(spark, d):
    m, t = F.col("doc_id") % 5, F.col("text")
    v = F.when(m == 0, F.concat(F.lit('<figure type="figure"><description>'), t, F.lit("</description></figure>"))).when(m == 1, F.concat(F.lit(" <FIGURE><Description>"), t, F.lit("</DESCRIPTION>\n</figure> "))).when(m == 2, F.concat(F.lit("<figure>"), t, F.lit("</figure>"))).when(m == 3, F.concat(F.lit("<figure><description>"), t)).otherwise(t)
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", X.is_semantic_visual(v).alias("semantic"))


@query("fallback_content", f"WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_NORMAL} ELSE '' END AS own, CASE WHEN doc_id % 4 = 1 THEN 'md' ELSE '' END AS md, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS other FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN own <> '' OR md <> '' THEN own ELSE other END AS content, CASE WHEN own <> '' OR md <> '' THEN coalesce(nullif(md, ''), own) ELSE other END AS markdown, CASE WHEN own <> '' OR md <> '' THEN 'page_draft' WHEN other <> '' THEN 'crop_fallback' ELSE 'page_draft' END AS source_pass FROM n")
def fallback_content(spark, d):
    k = F.col("doc_id")
    c = X.best_content(F.when(k % 3 == 0, F.col("text")).otherwise(" "), F.when(k % 4 == 1, " md ").otherwise(""), F.when(k % 5 == 0, "").otherwise(F.col("lang")), F.lit(""))
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", c["text"].alias("content"), c["markdown"].alias("markdown"), c["source_pass"].alias("source_pass"))


@query("fenced_json", "SELECT event_id, props FROM events")
def fenced_json(spark, d):
    return S.table(spark, d, "events").select("event_id", X.strip_fences(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("props"))


# --- order-dependent page operators --------------------------------------------------------------------------------


def _page_chunks(spark, d):
    """All lines of all documents, ten to a page and each twice, with boxes of embeddings.

    Boxes come to pages by numbers alone, so a line is shuffled once, to its page, and doubled there."""
    e = S.embedding_boxes(spark, d).select(F.col("seq").alias("vec"), "box")
    whose = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256)))
    docs = S.table(spark, d, "documents").select(whose.alias("whose"), F.xxhash64("doc_id").alias("h"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    page = lambda tens: F.concat_ws(":", "whose", tens.cast("string")).alias("page")
    # rows of one id share their pages and boxes
    sizes = docs.groupBy("whose").agg(F.max(F.size("lines")).alias("n"), F.min("h").alias("h")).crossJoin(e.agg(F.greatest(F.max("vec") + 1, F.lit(1)).alias("n_vec")))
    places = sizes.select("whose", "h", "n_vec", F.explode(F.sequence(F.lit(0), 2 * F.col("n") - 1)).alias("seq"))
    places = places.select(page(F.expr("seq div 20")), "seq", F.pmod(F.pmod("h", F.lit(1 << 40)) + F.col("seq"), "n_vec").alias("vec")).join(e, "vec", "left")
    boxes = places.groupBy("page").agg(F.collect_list(F.struct("seq", "box")).alias("boxes"))
    lines = docs.select("whose", F.posexplode("lines").alias("i", "line")).groupBy(page(F.expr("i div 10"))).agg(F.collect_list(F.struct("i", "line")).alias("lines"))
    c = lines.join(boxes, "page").select("page", F.explode("lines").alias("l"), "boxes").select("page", "l", F.explode(F.filter("boxes", lambda b: F.floor(b["seq"] / 2) == F.col("l.i"))).alias("b"))
    c = c.select("page", F.col("l.line").alias("line"), F.col("b.seq").alias("seq"), F.col("b.box").alias("box"))
    kind = F.element_at(F.array(*map(F.lit, ["text", "heading", "list", "figure"])), (F.expr("seq div 2") % 4 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ["verified", "candidate", "unresolved"])), (F.col("seq") % 3 + 1).cast("int"))
    return c.select("page", "seq", kind.alias("type"), F.col("line").alias("text"), status.alias("status"), (F.col("seq") % 5 == 0).alias("exact"), *[F.col(f"box.{s}").alias(s) for s in G.SIDES])


@query("suppress_duplicates")
def suppress_duplicates(spark, d):
    return reconcile.suppress_duplicates(_page_chunks(spark, d), ["page"]).select("page", "seq", "type", "status")


@query("dedup_regions", _BOXES + """, g AS (SELECT seq // 20 AS page, list([{'seq': seq, 'score': seq * 37 % 101 / 100.0, 'l': l, 't': t, 'r': r, 'b': b}] ORDER BY seq) AS items FROM boxes GROUP BY 1),
k AS (SELECT page, unnest(list_reduce(items, lambda a, x: CASE WHEN list_contains(list_transform(a, lambda o: greatest(0.0, least(o.r, x[1].r) - greatest(o.l, x[1].l)) * greatest(0.0, least(o.b, x[1].b) - greatest(o.t, x[1].t)) / least((o.r - o.l) * (o.b - o.t), (x[1].r - x[1].l) * (x[1].b - x[1].t)) >= 0.9), true)
  THEN list_transform(a, lambda o, i: CASE WHEN x[1].score > o.score AND i = list_position(list_transform(a, lambda o: greatest(0.0, least(o.r, x[1].r) - greatest(o.l, x[1].l)) * greatest(0.0, least(o.b, x[1].b) - greatest(o.t, x[1].t)) / least((o.r - o.l) * (o.b - o.t), (x[1].r - x[1].l) * (x[1].b - x[1].t)) >= 0.9), true) THEN x[1] ELSE o END)
  ELSE list_concat(a, x) END)) AS o FROM g)
SELECT page, o.seq AS seq, CAST(o.score AS DOUBLE) AS score FROM k""")
def dedup_regions(spark, d):
    b = S.embedding_boxes(spark, d)
    r = b.select(F.expr("seq div 20").alias("page"), "seq", *[F.col(f"box.{s}").alias(s) for s in G.SIDES], (F.col("seq") * 37 % 101 / 100.0).alias("score"))
    return reconcile.dedup_regions(r, ["page"]).select("page", "seq", "score")


def _passes(spark, d, other: str):
    c = _page_chunks(spark, d)
    half = F.when(F.col("seq") % 2 == 0, "draft").otherwise(other)
    w = Window.partitionBy("page", "source").orderBy("seq", "text", *G.SIDES)
    c = c.withColumn("source", half)
    n = F.row_number().over(w)
    return c.withColumn("parent_order", F.when(F.col("seq") % 3 == 0, n - 1)).withColumn("seq", n)


@query("merge_reconciled")
def merge_reconciled(spark, d):
    return reconcile.merge_reconciled(_passes(spark, d, "verification"), ["page"])


@query("merge_figures")
def merge_figures(spark, d):
    return reconcile.merge_figures(_passes(spark, d, "group"), ["page"])


@query("agreement")
def agreement(spark, d):
    c = _passes(spark, d, "verification").withColumns({"markdown": F.lit(None).cast("string"), "box": G.box(*[F.col(s) for s in G.SIDES])})
    return reconcile.agreeing(c.where("source = 'draft'"), c.where("source = 'verification'"), ["page"]).select("page", "seq", "type")


@query("scored_regions", _BOXES + "SELECT seq // 20 AS page, seq FROM boxes WHERE seq * 37 % 101 / 100.0 >= 0.95")
def scored_regions(spark, d):
    """Regions of which only those with a high score count; these lie too far apart in a page to be doubles."""
    b = S.embedding_boxes(spark, d)
    w = F.col("seq") % 20 * 0.04
    r = b.select(F.expr("seq div 20").alias("page"), "seq", w.alias("left"), F.lit(0.0).alias("top"), (w + 0.03).alias("right"), F.lit(0.5).alias("bottom"), (F.col("seq") * 37 % 101 / 100.0).alias("score"))
    return reconcile.dedup_regions(r, ["page"], least_score=0.95).select("page", "seq")


@query("orphan_parents", "SELECT l_orderkey AS doc_id, l_linenumber AS id, CASE WHEN EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber - 1) THEN l_linenumber - 1 END AS parent_id FROM lineitem l")
def orphan_parents(spark, d):
    c = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") - 1).alias("parent_id"))
    return reconcile.repaired_parents(c, ["doc_id"])


@query("call_budget", """WITH e AS (SELECT user_id AS page, event_id AS seq, event_type IN ('error', 'view') AS v, event_type = 'error' AS c, CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 6 END AS nv, CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 5 END AS nc FROM events)
SELECT page, seq, v AND sum(CAST(v AS INTEGER)) OVER w <= nv AS may_verify, c AND sum(CAST(c AS INTEGER)) OVER w <= nc AS may_crop FROM e WINDOW w AS (PARTITION BY page ORDER BY seq)""")
def call_budget(spark, d):
    e = S.table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "view").alias("wants_verify"), (F.col("event_type") == "error").alias("wants_crop"))
    mode = F.element_at(F.array(*map(F.lit, ["economy", "balanced", "audit"])), (F.col("page") % 3 + 1).cast("int"))
    return reconcile.within_budget(e, ["page"], "seq", mode).select("page", "seq", "may_verify", "may_crop")


#: Texts of page chunks, unlike each other; the last one has a critical token.
_SAYINGS = ["alpha beta gamma", "lorem ipsum dolor sit", "", "one small step for us", "call INV77 now"]
_OBSERVED = f"""WITH e AS (SELECT user_id AS page, event_id AS ord, list_extract(['text', 'list', 'figure'], CAST(event_id % 3 + 1 AS BIGINT)) AS type, list_extract({_SAYINGS}, CAST(event_id % 5 + 1 AS BIGINT)) AS text,
  CASE WHEN event_id % 6 <> 0 THEN 0.1 * (event_id % 5) END AS l, 0.1 * (event_id % 4) AS t, list_extract(['economy', 'balanced', 'audit'], CAST(user_id % 3 + 1 AS BIGINT)) AS mode, user_id % 5 = 0 AS ready, user_id % 7 = 0 AS broken, user_id % 4 = 0 AS scan,
  user_id % 2 = 1 AND event_id % 5 = 0 AS exact, event_id % 11 = 0 AS specialist, event_id % 2 = 0 AS second, list_extract({_SAYINGS}, CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 5 ELSE (event_id + 1) % 5 END + 1 AS BIGINT)) AS draft_text FROM events),
c AS (SELECT *, NOT ready AND (mode = 'audit' OR mode = 'balanced' AND page % 2 = 0) AS again, mode = 'audit' AND (contains(text, 'INV77')) AS precise FROM e),
pairs AS (SELECT c.page, c.ord, d.ord AS draft, d.type AS d_type, d.text AS own, d.draft_text, d.l AS d_l, d.t AS d_t, d.type = c.type AND d.draft_text = c.text AND c.text <> '' AS same,
  CASE WHEN d.l IS NULL THEN 1.0 ELSE greatest(0.0, least(c.l, d.l) + 0.3 - greatest(c.l, d.l)) * greatest(0.0, least(c.t, d.t) + 0.3 - greatest(c.t, d.t)) / 0.09 END AS overlap FROM c JOIN e d ON c.page = d.page WHERE c.again AND c.l IS NOT NULL),
agreed AS (SELECT DISTINCT page, ord FROM pairs WHERE same AND d_l IS NOT NULL AND overlap >= 0.5),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, ord ORDER BY round(overlap, 6) DESC, draft) AS rn FROM pairs) WHERE rn = 1),
"""


def _observed(spark, d):
    """Chunks, pages and drafts of pages, from events."""
    pick = lambda items, i: F.element_at(F.array(*map(F.lit, items)), (i + 1).cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    left, top = 0.1 * (e % 5), 0.1 * (e % 4)
    box = G.box(left, top, F.when(e % 6 != 0, left + 0.3).otherwise(left), top + 0.3)
    c = S.table(spark, d, "events").select(
        u.alias("page"), e.alias("order"), pick(["text", "list", "figure"], e % 3).alias("type"), pick(_SAYINGS, e % 5).alias("text"), pick(_SAYINGS, e % 5).alias("markdown"), box.alias("box"),
        (e % 2 == 0).alias("reconciled"), F.lit(False).alias("draft_fallback"), (e % 11 == 0).alias("specialist"), pick(_SAYINGS, F.when(e % 2 == 0, e % 5).otherwise((e + 1) % 5)).alias("draft_text"),
    )
    drafts = c.select("page", F.col("order").alias("seq"), "type", F.col("draft_text").alias("text"), F.lit("").alias("markdown"), "box")
    mode, p = pick(["economy", "balanced", "audit"], F.col("page") % 3), F.col("page")
    again = (p % 5 != 0) & ((mode == "audit") | ((mode == "balanced") & (p % 2 == 0)))
    words = F.array(*[F.struct(F.lit(w).alias("text"), G.box(0.1 * i, 0.0, 0.1 * i + 0.1, 0.1).alias("box")) for i, w in enumerate(_SAYINGS[0].split())])
    pages = c.select("page").distinct().select("page", mode.alias("mode"), (p % 5 == 0).alias("presegmented"), again.alias("reconciled_page"), (p % 7 == 0).alias("reconciliation_failed"), (p % 4 == 0).alias("scan_like"), F.when(p % 2 == 1, words).otherwise(F.slice(words, 1, 0)).alias("words"))
    return c.drop("draft_text"), pages, drafts


@query("chunk_resolution", _OBSERVED + """told AS (SELECT c.*, a.ord IS NOT NULL AND NOT specialist AS agree, b.draft, b.draft_text AS best_text FROM c LEFT JOIN agreed a ON a.page = c.page AND a.ord = c.ord AND NOT c.broken LEFT JOIN best b ON b.page = c.page AND b.ord = c.ord AND NOT c.specialist),
k AS (SELECT *, CASE WHEN exact THEN 'exact' WHEN l IS NULL AND scan AND text <> '' THEN 'kept' WHEN l IS NULL THEN 'lost' WHEN ready THEN 'single' WHEN again AND (agree OR specialist OR mode = 'audit' AND second) AND NOT precise THEN 'confirmed' WHEN again AND broken THEN 'failed' WHEN NOT again AND mode = 'economy' THEN 'single' ELSE 'crop' END AS kind,
  draft IS NOT NULL AND (NOT precise OR best_text <> '') AS take FROM told)
SELECT page, ord AS "order", CASE WHEN kind IN ('exact', 'confirmed') THEN 'verified' WHEN kind = 'lost' OR kind IN ('kept', 'failed') AND mode = 'audit' THEN 'unresolved' WHEN kind <> 'crop' THEN 'candidate' END AS status,
  CASE WHEN kind = 'exact' THEN 'text_layer_exact' WHEN kind IN ('single', 'confirmed', 'failed') THEN 'vision_refined' END AS method, CASE WHEN kind = 'confirmed' THEN 'page_reconciliation' WHEN kind <> 'crop' THEN 'page_draft' END AS source_pass,
  CASE kind WHEN 'kept' THEN 'invalid_draft_box,scan_fallback_used' WHEN 'lost' THEN 'invalid_draft_box' WHEN 'single' THEN 'single_model_candidate' WHEN 'failed' THEN 'page_reconciliation_failed' WHEN 'crop' THEN NULL ELSE '' END AS warnings,
  CASE kind WHEN 'lost' THEN '' WHEN 'crop' THEN NULL ELSE text END AS text, CASE WHEN kind = 'crop' THEN CASE WHEN take THEN best_text ELSE text END END AS crop_text,
  CASE WHEN kind = 'crop' THEN CASE WHEN take OR NOT again THEN 'page_draft' WHEN specialist THEN 'figure_reconciliation' ELSE 'page_reconciliation' END END AS crop_from, CASE WHEN kind = 'crop' THEN CASE WHEN again AND precise THEN 'precision_crop' ELSE 'crop_verification' END END AS crop_pass FROM k""")
def chunk_resolution(spark, d):
    out = resolve.settled(*_observed(spark, d), ["page"])
    return out.select("page", "order", "said.status", "said.method", "said.source_pass", F.array_join("said.warnings", ",").alias("warnings"), "said.text", F.col("crop.text").alias("crop_text"), F.col("crop.source_pass").alias("crop_from"), F.col("crop.verified_pass").alias("crop_pass"))


@query("crop_verdicts", f"""WITH w AS (SELECT user_id AS page, event_id AS ord, list_extract(['text', 'list', 'figure'], CAST(event_id % 3 + 1 AS BIGINT)) AS type, list_extract({_SAYINGS}, CAST(event_id % 5 + 1 AS BIGINT)) AS text, list_extract(['balanced', 'audit'], CAST(user_id % 2 + 1 AS BIGINT)) AS mode, user_id % 4 = 1 AS scan FROM events),
a AS (SELECT *, unnest(range(1, ord % 4 + 1)) AS attempt FROM w),
s AS (SELECT *, (ord + attempt) % 5 = 0 AS bad, (ord + attempt) % 3 = 0 AND (ord + attempt) % 7 <> 0 AND type <> 'figure' AS readable, attempt % 2 = 0 AND ord % 2 = 1 AS away, CASE WHEN (ord + attempt) % 7 = 0 THEN '' ELSE 'seen ' || CAST(attempt AS VARCHAR) END AS seen FROM a),
k AS (SELECT *, CASE WHEN bad THEN 'invalid_box' WHEN readable AND NOT away THEN 'verified' WHEN readable THEN 'scope_drift' END AS kind FROM s),
g AS (SELECT page, ord, arg_min(kind, attempt) FILTER (kind IS NOT NULL) AS kind, coalesce(arg_min(seen, attempt) FILTER (kind IS NOT NULL), arg_max(seen, attempt)) AS seen, count(*) AS calls FROM k GROUP BY page, ord),
o AS (SELECT w.*, coalesce(calls, 0) AS calls, seen, CASE WHEN calls IS NULL THEN 'budget_exhausted' ELSE coalesce(kind, 'disagreement') END AS outcome, CASE WHEN text <> '' THEN text ELSE coalesce(seen, '') END AS best, CASE WHEN text <> '' THEN 'page_reconciliation' WHEN coalesce(seen, '') <> '' THEN 'crop_fallback' ELSE 'page_draft' END AS best_pass FROM w LEFT JOIN g ON w.page = g.page AND w.ord = g.ord),
p AS (SELECT *, mode = 'balanced' OR scan AND best <> '' AS keep FROM o)
SELECT page, ord AS "order", outcome, calls, CASE WHEN outcome = 'verified' THEN 'verified' WHEN outcome = 'budget_exhausted' AND mode <> 'audit' OR outcome <> 'budget_exhausted' AND keep AND mode <> 'audit' THEN 'candidate' ELSE 'unresolved' END AS status,
  CASE outcome WHEN 'budget_exhausted' THEN text WHEN 'verified' THEN seen ELSE CASE WHEN keep THEN best ELSE '' END END AS text,
  CASE outcome WHEN 'budget_exhausted' THEN 'page_reconciliation' WHEN 'verified' THEN 'precision_crop' ELSE CASE WHEN keep OR outcome = 'scope_drift' THEN best_pass ELSE 'page_draft' END END AS source_pass,
  CASE outcome WHEN 'budget_exhausted' THEN 'verification_budget_exhausted' WHEN 'verified' THEN '' ELSE CASE outcome WHEN 'invalid_box' THEN 'invalid_verification_box' WHEN 'scope_drift' THEN 'verification_scope_drift' ELSE 'visual_disagreement' END || CASE WHEN keep AND scan THEN ',scan_fallback_used' ELSE '' END END AS warnings FROM p""")
def crop_verdicts(spark, d):
    chunks, _, _ = _observed(spark, d)
    box = G.box(0.2, 0.2, 0.6, 0.6)
    mode = F.when(F.col("page") % 2 == 0, "balanced").otherwise("audit")
    crop = F.struct("type", "text", F.lit("").alias("markdown"), box.alias("box"), F.lit("page_reconciliation").alias("source_pass"), F.lit("precision_crop").alias("verified_pass"))
    wanted = chunks.select("page", "order", mode.alias("mode"), (F.col("page") % 4 == 1).alias("scan_like"), crop.alias("crop"))
    n, k = F.col("order") + F.col("attempt"), F.col("attempt")
    tries = chunks.select("page", "order", F.explode(F.expr("filter(sequence(1, 3), i -> i <= `order` % 4)")).alias("attempt"))
    seen = F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("seen "), k.cast("string")))
    at = F.when((k % 2 == 0) & (F.col("order") % 2 == 1), 0.0).otherwise(0.4)
    inner = G.box(at, at, F.when(n % 5 == 0, at).otherwise(at + 0.2), at + 0.2)
    tries = tries.select("page", "order", "attempt", seen.alias("text"), seen.alias("markdown"), inner.alias("box"), F.when(n % 3 == 0, "verified").otherwise("unresolved").alias("verdict"), G.box(0.0, 0.0, 0.8, 0.8).alias("crop_box"))
    out = resolve.crop_results(wanted, tries, ["page"])
    return out.select("page", "order", "outcome", "calls", "said.status", "said.text", "said.source_pass", F.array_join("said.warnings", ",").alias("warnings"))


_ATTEMPTS = """WITH a AS (SELECT event_id // 40 AS page, event_id % 40 // 2 AS region, event_id % 2 + 1 AS attempt, user_id % 5 <> 0 OR event_id // 40 % 2 = 0 AS twice, CASE WHEN event_id // 2 % 9 = 4 THEN 'figure' ELSE 'text' END AS type,
  event_type IN ('error', 'click') AND event_id // 40 % 7 <> 0 AS failed, CASE WHEN event_id % 97 = 5 THEN 404 ELSE 503 END AS status, CASE WHEN value < 8 THEN '' ELSE 'text ' || CAST(event_id AS VARCHAR) END AS content, event_id % 100 AS tokens FROM events),
f AS (SELECT page, region, bool_and(twice) AS twice FROM a GROUP BY page, region), b AS (SELECT a.* EXCLUDE (twice), f.twice FROM a JOIN f USING (page, region)),
s AS (SELECT *, CASE WHEN failed AND (NOT twice OR status = 404) THEN 'stop' WHEN failed OR content = '' AND type = 'text' AND twice THEN CASE WHEN attempt < 2 THEN 'again' ELSE 'skipped' END ELSE 'done' END AS step FROM b),
m AS (SELECT * FROM (SELECT *, lag(step) OVER (PARTITION BY page, region ORDER BY attempt) AS before FROM s) WHERE attempt = 1 OR before = 'again'),
r AS (SELECT page, region, arg_max(step, attempt) AS step, arg_max(type, attempt) AS type, arg_max(content, attempt) AS content, sum(CASE WHEN failed THEN 0 ELSE tokens END) AS tokens FROM m GROUP BY page, region),
e AS (SELECT *, step = 'stop' OR sum(CAST(step = 'skipped' AS INTEGER)) OVER (PARTITION BY page ORDER BY region ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS ends FROM r),
t AS (SELECT * FROM (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY page ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS void FROM e) WHERE NOT void),
p AS (SELECT page, max(CASE WHEN step = 'stop' THEN 'Ollama OCR failed for area region ' || CAST(region AS VARCHAR) WHEN ends THEN 'DeepSeek OCR stopped after three consecutive region failures' END) AS error, count(*) FILTER (step = 'skipped') AS skipped, CAST(sum(tokens) AS BIGINT) AS tokens,
  count(*) FILTER (step = 'done' AND (content <> '' OR type = 'figure')) AS n, string_agg(content, '|' ORDER BY region) FILTER (step = 'done' AND (content <> '' OR type = 'figure')) AS texts FROM t GROUP BY page)
SELECT page, coalesce(error, CASE WHEN n = 0 THEN 'Ollama OCR returned no document content' END) AS error, skipped, tokens, CASE WHEN error IS NULL THEN coalesce(texts, '') ELSE '' END AS texts FROM p"""


@query("attempted_pages", _ATTEMPTS)
def attempted_pages(spark, d):
    """Events as a log of attempts: twenty regions a page, two attempts each, some in vain, some failing, some of a family that has one attempt only."""
    e, page = F.col("event_id"), F.expr("event_id div 40")
    a = S.table(spark, d, "events").select(page.alias("page"), F.expr("event_id % 40 div 2").alias("region"), (e % 2 + 1).alias("attempt"), ((F.col("user_id") % 5 != 0) | (page % 2 == 0)).alias("twice"), F.when(F.expr("event_id div 2 % 9") == 4, "figure").otherwise("text").alias("type"),
        (F.col("event_type").isin("error", "click") & (page % 7 != 0)).alias("failed"), F.when(e % 97 == 5, 404).otherwise(503).alias("status"), F.lit("http").alias("kind"), F.when(F.col("value") < 8, " ").otherwise(F.concat(F.lit("text "), e.cast("string"))).alias("content"), F.lit("area").alias("label"), (e % 100).alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    a = a.withColumn("family", F.when(F.bool_and("twice").over(Window.partitionBy("page", "region")), "deepseekocr").otherwise("glmocr"))
    out = reconcile.attempted_pages(a, ["page"], "region")
    return out.select("page", "error", F.size("warnings").cast("long").alias("skipped"), F.col("input_tokens").alias("tokens"), F.array_join(F.transform("chunks", lambda c: c["content"]), "|").alias("texts"))


@query("resolved_chunks")
def resolved_chunks(spark, d):
    """Chunks of all pages through the whole resolution: agreement, crops and their attempts, and figures without a description."""
    chunks, pages, drafts = _observed(spark, d)
    n, k = F.col("order") + F.col("attempt"), F.col("attempt")
    tries = chunks.select("page", "order", F.explode(F.expr("filter(sequence(1, 3), i -> i <= `order` % 4)")).alias("attempt"))
    seen = F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("seen "), k.cast("string")))
    tries = tries.select("page", "order", "attempt", seen.alias("text"), seen.alias("markdown"), G.box(0.4, 0.4, F.when(n % 5 == 0, 0.4).otherwise(0.6), 0.6).alias("box"), F.when(n % 3 == 0, "verified").otherwise("unresolved").alias("verdict"), G.box(0.0, 0.0, 0.8, 0.8).alias("crop_box"))
    out = resolve.resolved_chunks(chunks, pages, drafts, tries, ["page"])
    return out.select("page", "order", "type", "status", "method", "text", "markdown", F.array_join("warnings", ",").alias("warnings"), "source_pass")


@query("region_outcomes", """WITH a AS (SELECT user_id AS page, event_id // 2 AS region, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2),
f AS (SELECT *, t = 'error' AS failed, sum(CAST(t = 'error' AS INTEGER)) OVER (PARTITION BY page ORDER BY region ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS three FROM a),
g AS (SELECT *, max(CAST(three AS INTEGER)) OVER (PARTITION BY page ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 AS gone FROM f)
SELECT page, region, t AS type FROM g WHERE NOT failed AND NOT coalesce(gone, false) AND v >= 5""")
def region_outcomes(spark, d):
    e = S.table(spark, d, "events").select(F.col("user_id").alias("page"), F.expr("event_id div 2").alias("region"), F.col("event_id").alias("attempt"), F.col("event_type").alias("type"), F.when(F.col("value") >= 5, "x").otherwise(" ").alias("text"), (F.col("event_type") == "error").alias("failed"))
    return reconcile.region_outcomes(e, ["page"], "region").select("page", "region", "type")


def _worded(spark, d):
    """Documents as pages whose words are native ones, each with a box in a row."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    p = S.table(spark, d, "documents").where("text is not null").select("doc_id", F.lit(1).alias("page"), "text", words.alias("words"))
    p = p.withColumn("n", F.greatest(F.size("words"), F.lit(1000)).cast("double"))
    boxes = F.transform("words", lambda w, i: F.struct(w.alias("text"), G.box(i / F.col("n"), F.lit(0.1), (i + 1) / F.col("n"), F.lit(0.2)).alias("box")))
    return p.withColumn("boxes", boxes)


_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
_WORDS = f"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_BLANKS}'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)
"""
_KEY = "replace(lower(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+', '', 'g')), 'ß', 'ss')"


@query("align_words", _WORDS + f""", k AS (SELECT doc_id, greatest(len(ws), 1000) AS n, list_transform(ws, lambda x: {_KEY.format('x')}) AS keys, list_filter(list_transform(ws[4:8], lambda x: {_KEY.format('x')}), lambda x: x <> '') AS wanted FROM w),
h AS (SELECT *, chr(10) || array_to_string(keys, chr(10)) || chr(10) AS have, chr(10) || array_to_string(wanted, chr(10)) || chr(10) AS want FROM k),
b AS (SELECT *, CASE WHEN len(wanted) > 0 AND strpos(have, want) > 0 THEN left(have, strpos(have, want)) END AS before FROM h), a AS (SELECT *, CAST(length(before) - length(replace(before, chr(10), '')) - 1 AS INTEGER) AS k FROM b)
SELECT doc_id, k AS "at", round(k / CAST(n AS DOUBLE), 6) AS l, round((k + len(wanted)) / CAST(n AS DOUBLE), 6) AS r FROM a""")
def align_words(spark, d):
    p = _worded(spark, d).withColumn("wanted", F.array_join(F.slice("words", 4, 5), " "))
    p = p.select("doc_id", align.alignment(F.col("wanted"), F.col("boxes")).alias("a"))
    return p.select("doc_id", "a.at", F.round("a.box.left", 6).alias("l"), F.round("a.box.right", 6).alias("r"))


@query("ground_words", _WORDS + """, m AS (SELECT doc_id, text, list_transform(ws, lambda x, i: CASE WHEN doc_id % 2 = 1 AND i % 7 = 0 THEN x || '¤' ELSE x END) AS ws FROM w WHERE len(ws) > 0),
p AS (SELECT doc_id, ws, list_reduce(list_transform(ws, lambda x: {'w': x, 'c': 0::BIGINT, 'o': []::BIGINT[]}), lambda a, x: {'w': '',
  'c': CASE WHEN contains(substr(text, a.c + 1, 300), x.w) THEN a.c + strpos(substr(text, a.c + 1, 300), x.w) - 1 + length(x.w) WHEN contains(substr(text, a.c + 1), x.w) THEN a.c + strpos(substr(text, a.c + 1), x.w) - 1 + length(x.w) ELSE a.c END,
  'o': list_append(a.o, CASE WHEN contains(substr(text, a.c + 1, 300), x.w) THEN a.c + strpos(substr(text, a.c + 1, 300), x.w) - 1 WHEN contains(substr(text, a.c + 1), x.w) THEN a.c + strpos(substr(text, a.c + 1), x.w) - 1 END)}, {'w': '', 'c': 0::BIGINT, 'o': []::BIGINT[]}).o AS starts FROM m),
u AS (SELECT doc_id, unnest(ws) AS text, CAST(unnest(starts) AS INTEGER) AS start FROM p)
SELECT doc_id, 1 AS page, text, start, start + CAST(length(text) AS INTEGER) AS "end", CASE WHEN doc_id % 2 = 0 THEN 'native_pdf' ELSE 'local_ocr' END AS source FROM u WHERE start IS NOT NULL""")
def ground_words(spark, d):
    """Words of even documents are native; of the others, every seventh is misread and so not found."""
    misread = F.transform("words", lambda w, i: F.when(i % 7 == 6, F.concat(w, F.lit("\u00a4"))).otherwise(w))
    p = _worded(spark, d).select("doc_id", "page", "text", F.lit(0).alias("start"), F.when(F.col("doc_id") % 2 == 0, F.col("words")).alias("native"), misread.alias("ocr"))
    return align.grounded_words(p)


@query("place_lines", """WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ord FROM lines),
r AS (SELECT doc_id, ord, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) - length(line) - 1 AS start FROM u)
SELECT doc_id, count(*) AS n, CAST(max(start + length(line)) AS INTEGER) AS last FROM r WHERE line <> '' GROUP BY doc_id""")
def place_lines(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    p = S.table(spark, d, "documents").where("text is not null").select("doc_id", assemble.place(F.col("text"), lines).alias("p")).where("size(p) > 0")
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.element_at("p", -1)["end"].alias("last"))


@query("nest_cells", f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, 't' || CAST(l AS VARCHAR) AS t, list_filter(string_split_regex(line, '{_BLANKS}'), lambda x: x <> '') AS ws FROM lines),
m AS (SELECT *, '<td>' || array_to_string(ws, '</td><td>') || '</td>' AS md FROM t WHERE len(ws) > 0),
p AS (SELECT *, list_reduce(list_transform(ws, lambda x: {{'w': x, 'c': 0::BIGINT, 'o': []::BIGINT[]}}), lambda a, x: {{'w': '', 'c': CASE WHEN contains(substr(md, a.c + 1), x.w) THEN a.c + strpos(substr(md, a.c + 1), x.w) - 1 + length(x.w) ELSE a.c END,
  'o': list_append(a.o, CASE WHEN contains(substr(md, a.c + 1), x.w) THEN a.c + strpos(substr(md, a.c + 1), x.w) - 1 END)}}, {{'w': '', 'c': 0::BIGINT, 'o': []::BIGINT[]}}).o AS starts FROM m),
u AS (SELECT doc_id, t, unnest(ws) AS w, CAST(unnest(starts) AS INTEGER) AS start, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS i FROM p)
SELECT doc_id, 1 AS page, t AS parent_id, t || 'c' || CAST(i AS VARCHAR) AS id, CASE WHEN start IS NOT NULL THEN 0 END AS row, CASE WHEN start IS NOT NULL THEN i END AS col, start, start + CAST(length(w) AS INTEGER) AS "end", start IS NOT NULL AS nested FROM u""")
def nest_cells(spark, d):
    """Each line of a document is a table, and its words are the cells."""
    lines = S.table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "line"))
    t = lines.select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("t"), F.col("l").cast("string")).alias("t"), F.filter(F.split("line", r"\s+"), lambda x: x != "").alias("w"))
    tables = t.select("doc_id", "page", F.col("t").alias("id"), F.lit("table").alias("type"), F.lit(0).alias("order"), F.concat(F.lit("<td>"), F.array_join("w", "</td><td>"), F.lit("</td>")).alias("markdown"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"))
    cells = t.select("doc_id", "page", "t", F.posexplode("w").alias("i", "c")).select("doc_id", "page", F.concat("t", F.lit("c"), F.col("i").cast("string")).alias("id"), F.lit("table_cell").alias("type"), (F.col("i") + 1).alias("order"), F.col("c").alias("markdown"), F.col("t").alias("parent_id"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"))
    return assemble.nest_cells(tables.unionByName(cells))


@query("cell_checks", """WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 't' || CAST(l AS VARCHAR) AS id, 1 AS cell, 'table cell Markdown must occur in its parent table Markdown' AS violation FROM t WHERE l % 3 = 1 AND line <> ''""")
def cell_checks(spark, d):
    """Each line is a table of one cell; in every third, a second cell is missing."""
    lines = S.table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "line")).where("line <> ''")
    cells = F.when(F.col("l") % 3 == 1, F.array("line", F.concat("line", F.lit("\u00a4")))).otherwise(F.array("line"))
    return assemble.cell_violations(lines.select("doc_id", F.concat(F.lit("t"), F.col("l").cast("string")).alias("id"), F.concat(F.lit("<td>"), "line", F.lit("</td>")).alias("markdown"), cells.alias("cells")))


@query("word_checks", _BROKEN + "SELECT doc_id, markdown AS text, a AS start, 'word grounding text must match its Markdown range' AS violation FROM broken WHERE substr(whole, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) <> markdown")
def word_checks(spark, d):
    off, texts = _broken(spark, d)
    return assemble.word_violations(texts, off.select("doc_id", F.col("markdown").alias("text"), "start", "end"))


@query("clean_ocr")
def clean_ocr(spark, d):
    return align.clean_ocr(S.table(spark, d, "documents").select("doc_id", "text"), "text", "clean").select("doc_id", F.col("clean").alias("text"))


@query("clean_labels")
def clean_labels(spark, d):
    b = S.conversation_blocks(spark, d).select("doc_id", "page", F.col("ord").alias("seq"), F.when(F.col("ord") == 1, "heading").otherwise("text").alias("type"), F.col("markdown").alias("text"))
    return align.with_clean_labels(b, ["doc_id", "page"]).select("doc_id", "page", "seq", "clean")


# --- ingest --------------------------------------------------------------------------------------------------------


def _items(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["table", "picture", "text", "text"])), (F.col("seq") % 4 + 1).cast("int"))
    b = F.col("box")
    points = G.box(b["left"] * 600, 800 - b["top"] * 800, b["right"] * 600, 800 - b["bottom"] * 800)
    return S.embedding_boxes(spark, d).select(
        "page", "seq", kind.alias("kind"), F.concat(F.lit("label"), (F.col("seq") % 3).cast("string")).alias("label"), F.when(F.col("seq") % 8 != 2, F.concat(F.lit(" Item "), F.col("seq").cast("string"), F.lit("\n\nmore "))).alias("markdown"),
        F.lit(None).cast("string").alias("description"), F.when(F.col("seq") % 8 == 1, "A caption").alias("caption"), F.when(F.col("seq") % 5 != 0, points).alias("box"), F.lit(600).alias("width"), F.lit(800).alias("height"),
    )


@query("layout_blocks", _BOXES + """, k AS (SELECT page, seq, list_extract(['table', 'figure', 'text', 'text'], CAST(seq % 4 + 1 AS BIGINT)) AS type FROM boxes)
SELECT page, seq, type, CASE WHEN type = 'figure' THEN '<figure type="FIGURE"><description>Visual content present; description unavailable.</description>' || CASE WHEN seq % 8 = 1 THEN chr(10) || 'A caption' ELSE '' END || '</figure>' ELSE 'Item ' || CAST(seq AS VARCHAR) || chr(10) || chr(10) || 'more' END AS markdown,
'label' || CAST(seq % 3 AS VARCHAR) AS semantic_role, CASE WHEN seq % 5 <> 0 THEN 'grounded' ELSE 'semantic_only' END AS grounding_status, CASE WHEN seq % 5 = 0 OR type = 'table' THEN 0 WHEN type = 'figure' THEN CASE WHEN seq % 8 = 1 THEN 2 ELSE 1 END ELSE 2 END AS n_lines
FROM k WHERE type = 'figure' OR seq % 8 <> 2""")
def layout_blocks(spark, d):
    return ingest.layout_blocks(_items(spark, d)).select("page", "seq", "type", "markdown", "semantic_role", "grounding_status", F.size("lines").alias("n_lines"))


@query("table_cells", "SELECT page_id, CAST(ord - 1 AS INTEGER) AS ord, replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS markdown, CAST((ord - 1) % 4 AS INTEGER) AS row, CASE WHEN ord % 3 = 1 THEN 0 ELSE CAST(ord - 1 AS INTEGER) END AS col, CAST(1 + (ord - 1) % 2 AS INTEGER) AS rowspan, 1 AS colspan FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS c, generate_subscripts(string_split(html, chr(10)), 1) AS ord FROM pages) WHERE trim(c) <> ''")
def table_cells(spark, d):
    cells = F.transform(F.split("html", "\n"), lambda c, i: F.struct(c.alias("text"), (i % 4).alias("row"), F.when(i % 3 != 0, i).alias("col"), (1 + i % 2).alias("rowspan"), F.lit(None).cast("int").alias("colspan")))
    return ingest.table_cells(S.table(spark, d, "pages").select("page_id", cells.alias("cells")))


@query("page_markdown", _BOXES + "SELECT page, round(min(l), 6) AS l, round(max(b), 6) AS b, 'grounded' AS grounding_status FROM boxes WHERE page % 2 = 0 GROUP BY page UNION ALL SELECT DISTINCT page, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'semantic_only' FROM boxes WHERE page % 2 = 1")
def page_markdown(spark, d):
    b = S.embedding_boxes(spark, d)
    out = ingest.page_markdown_blocks(b.select("page").distinct().withColumn("markdown", F.lit(" text ")), b.where("page % 2 = 0"), ["page"])
    return out.select("page", F.round("box.left", 6).alias("l"), F.round("box.bottom", 6).alias("b"), "grounding_status")


@query("atomic_lines", _BOXES + "SELECT page, count(*) FILTER (seq % 3 <> 0 AND seq % 4 <> 0 AND r <= 1 AND b <= 1) AS n FROM boxes GROUP BY page")
def atomic_lines(spark, d):
    b = F.col("box")
    k = F.when(F.col("seq") % 4 == 0, -1.0).otherwise(1.0)
    line = F.struct(F.when(F.col("seq") % 3 == 0, " ").otherwise("x").alias("text"), F.when((b["right"] <= 1) & (b["bottom"] <= 1), G.box(*[b[s] * k for s in G.SIDES])).alias("box"))
    g = S.embedding_boxes(spark, d).withColumn("line", line).groupBy("page").agg(F.collect_list("line").alias("lines"))
    return g.select("page", F.size(ingest.atomic_lines(F.col("lines"))).cast("long").alias("n"))


@query("normalized_chunks", _BOXES + "SELECT seq, CASE WHEN seq % 2 = 0 THEN 'text' ELSE 'md' END AS markdown, round(l, 6) AS l FROM boxes WHERE r <= 1 AND b <= 1")
def normalized_chunks(spark, d):
    b = F.col("box")
    c = S.embedding_boxes(spark, d).where("box.right <= 1 and box.bottom <= 1").select("seq", F.lit("text").alias("text"), F.when(F.col("seq") % 2 != 0, "md").alias("markdown"), F.when(F.col("seq") % 3 == 0, G.box(*[b[s] * 1000 for s in G.SIDES])).otherwise(b).alias("box"))
    return ingest.normalized_chunks(c).select("seq", "markdown", F.round("box.left", 6).alias("l"))


@query("geometry_errors", _BOXES + "SELECT page, '$.chunks[' || CAST(min(i) - 1 AS VARCHAR) || '].box must have left < right and top < bottom' AS error FROM (SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY seq) AS i FROM boxes) WHERE seq % 7 = 0 GROUP BY page")
def geometry_errors(spark, d):
    b = F.col("box")
    c = S.embedding_boxes(spark, d).withColumn("box", F.when(F.col("seq") % 7 == 0, G.box(b["right"], b["top"], b["left"], b["bottom"])).otherwise(b))
    g = c.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "box"))), lambda x: x["box"]).alias("boxes"))
    return g.select("page", ingest.geometry_error(F.col("boxes")).alias("error")).where("error is not null")


@query("block_counts", _BLOCKS + "SELECT doc_id, count(*) AS blocks FROM ranged GROUP BY doc_id")
def block_counts(spark, d):
    return ingest.block_count(export.export_nodes(_ranged(spark, d).withColumn("box", F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>"))))


@query("block_violations", """WITH e AS (SELECT event_id, event_id % 2 = 0 AS g, event_id % 3 = 0 AS nobox, list_extract(['text', 'table', 'table_cell'], CAST(event_id % 5 % 3 + 1 AS BIGINT)) AS t, event_id % 7 = 0 AS hasrow, event_id % 11 = 0 AS cells FROM events)
SELECT event_id, CASE WHEN g AND nobox THEN 'grounded block input requires a normalized box' WHEN NOT g AND NOT nobox THEN 'semantic-only block input cannot claim a normalized box' WHEN t = 'table_cell' AND NOT hasrow THEN 'table cell input requires row and col' WHEN t = 'table_cell' AND cells THEN 'table cell input cannot contain table cells' WHEN t <> 'table_cell' AND hasrow THEN 'only table cell input accepts row and col' WHEN t <> 'table' AND cells THEN 'only table input can contain table cells' END AS violation FROM e""")
def block_violations(spark, d):
    m = lambda k: F.col("event_id") % k == 0
    t = F.element_at(F.array(*map(F.lit, ["text", "table", "table_cell"])), (F.col("event_id") % 5 % 3 + 1).cast("int"))
    b = F.struct(t.alias("type"), F.when(m(2), "grounded").otherwise("semantic_only").alias("grounding_status"), F.when(~m(3), G.box(0.0, 0.0, 1.0, 1.0)).alias("box"), F.when(m(7), 1).alias("row"), F.when(m(7), 1).alias("col"), F.when(m(11), 2).otherwise(0).alias("n_cells"))
    return S.table(spark, d, "events").withColumn("b", b).select("event_id", ingest.block_violation(F.col("b")).alias("violation"))


@query("chunk_violations", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'malformed id' WHEN event_id % 3 = 0 AND event_id % 2 = 1 THEN 'verified chunk requires grounding evidence' END AS violation FROM events")
def chunk_violations(spark, d):
    m = lambda k: F.col("event_id") % k == 0
    chunk_id = F.concat(F.when(m(4), "-bad ").otherwise("c:"), F.col("event_id").cast("string"))
    return S.table(spark, d, "events").select("event_id", ingest.chunk_violation(chunk_id, F.when(m(3), "verified").otherwise("candidate"), F.when(m(2), 1)).alias("violation"))


@query("node_violations", """SELECT event_id, CASE WHEN t = 'document' AND NOT nopage THEN 'document has no page' WHEN t = 'page' AND nopage THEN 'page needs its number' WHEN t = 'table_cell' AND nopage THEN 'block needs its page' WHEN t = 'table_cell' AND NOT cell THEN 'table cell needs row and column' WHEN t <> 'table_cell' AND cell THEN 'only table cells have row and column' WHEN t = 'table_cell' AND event_id % 13 = 0 THEN 'grounded node needs a box' END AS violation
FROM (SELECT event_id, list_extract(['document', 'page', 'table_cell'], CAST(event_id % 3 + 1 AS BIGINT)) AS t, event_id % 2 = 0 AS nopage, event_id % 5 = 0 AS cell FROM events)""")
def node_violations(spark, d):
    m = lambda k: F.col("event_id") % k == 0
    t = F.element_at(F.array(*map(F.lit, ["document", "page", "table_cell"])), (F.col("event_id") % 3 + 1).cast("int"))
    n = F.struct(t.alias("type"), F.when(~m(2), 1).alias("page"), F.when(m(5), 0).alias("row"), F.when(m(5), 0).alias("col"), F.lit("grounded").alias("grounding_status"), F.when(~m(13), G.box(0.0, 0.0, 1.0, 1.0)).alias("box"), F.lit("table").alias("parent_type"))
    return S.table(spark, d, "events").withColumn("n", n).select("event_id", assemble.node_violation(F.col("n")).alias("violation"))
