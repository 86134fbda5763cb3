"""Exports, checks of documents, and texts against plain Python."""

import html
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import assemble, export, quality, routing

BOX = "struct<left:double,top:double,right:double,bottom:double>"
ATOMIC = f"array<struct<start:bigint,end:bigint,box:{BOX}>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ground(page, start, end, box):
    return {"page": page, "range": {"start": start, "end": end}, "box": dict(zip(("xmin", "ymin", "xmax", "ymax"), box, strict=True))}


FULL, PART = (0.0, 0.0, 1.0, 1.0), (0.1, 0.2, 0.3, 0.4)


@pytest.fixture(scope="module")
def exported(spark):
    ddl = f"doc_id int, page_seq int, page int, seq int, type string, node_id string, start bigint, end bigint, box {BOX}, status string, parent_id string, row int, col int, rowspan int, colspan int, atomic {ATOMIC}"
    rows = [
        (1, 1, 3, 0, "page", "page-0", 0, 9, FULL, "ok", None, None, None, None, None, None), (1, 2, 4, 0, "page", "page-1", 9, 9, FULL, "failed", None, None, None, None, None, None),
        (1, 1, 3, 1, "text", "text-0", 0, 4, PART, "ok", None, None, None, None, None, [(0, 4, PART)]), (1, 1, 3, 2, "table", "table-0", 4, 9, FULL, "ok", None, None, None, None, None, [(4, 9, PART)]),
        (1, 1, 3, 3, "table_cell", "table_cell-0", 5, 6, PART, "ok", "table-0", 0, 1, 1, 2, None), (1, 1, 3, 4, "text", "text-1", 9, 9, FULL, "ok", None, None, None, None, None, []),
    ]
    nodes = spark.createDataFrame(rows, ddl)
    texts = spark.createDataFrame([(1, "naïve 😀x")], "doc_id int, markdown string")
    meta = spark.createDataFrame([(1, "j", 12, [4], "hybrid", ["careful"])], "doc_id int, job_id string, source_page_count bigint, failed_pages array<int>, engine string, warnings array<string>")
    return nodes, texts, meta


def tree():
    none = {"row": None, "col": None, "rowspan": None, "colspan": None}
    cell = {"id": "table_cell-0", "type": "table_cell", "grounding": ground(3, 5, 6, PART), "atomic_grounding": [], "row": 0, "col": 1, "rowspan": 1, "colspan": 2}
    blocks = [
        {"id": "text-0", "type": "text", "grounding": ground(3, 0, 4, PART), "atomic_grounding": [ground(3, 0, 4, PART)], **none, "children": []},
        {"id": "table-0", "type": "table", "grounding": ground(3, 4, 9, FULL), "atomic_grounding": None, **none, "children": [cell]},
        {"id": "text-1", "type": "text", "grounding": ground(3, 9, 9, FULL), "atomic_grounding": None, **none, "children": []},
    ]
    pages = [
        {"id": "page-0", "type": "page", "grounding": ground(3, 0, 9, FULL), "status": "ok", "reason": None, "children": blocks},
        {"id": "page-1", "type": "page", "grounding": ground(4, 9, 9, FULL), "status": "failed", "reason": "Page processing failed", "children": None},
    ]
    meta = {"job_id": "j", "model_version": "v", "page_count": 12, "output_markdown_chars": 8, "failed_pages": [4], "duration_ms": None, "billing": {"service_tier": "local", "total_credits": None}}
    return {"markdown": "naïve 😀x", "metadata": meta, "structure": {"id": "document-0", "type": "document", "children": pages}}


def test_export(exported):
    nodes, texts, meta = exported
    assert json.loads(export.export_json(nodes, texts, meta, "v").first().json) == tree()
    bare = json.loads(export.export_json(nodes.drop("atomic", "row", "col", "rowspan", "colspan", "parent_id").where("type <> 'table_cell'"), texts).first().json)
    assert bare["metadata"]["page_count"] == 2 and bare["metadata"]["failed_pages"] == [] and bare["structure"]["children"][0]["children"][0]["atomic_grounding"] is None


def test_wrapped_export(spark, exported):
    nodes, texts, meta = exported
    words = spark.createDataFrame([(1, 2, "b", 3, 1, 2, PART, None), (1, 1, "a", 3, 0, 1, PART, 0.5)], f"doc_id int, seq int, text string, page int, start int, end int, box {BOX}, confidence double")
    relations = spark.createDataFrame([(1, "section_start", "text-0")], "doc_id int, kind string, block_id string")
    usage = spark.createDataFrame([(1, "m", 7), (2, "m", 9)], "doc_id int, model_id string, input_tokens bigint")
    got = json.loads(export.wrapped_export(nodes, texts, words, relations, usage, meta, "v").first().json)
    assert got["ade"] == tree() and got["engine"] == "hybrid" and got["warnings"] == ["careful"] and got["provenance"] == {}
    assert got["words"] == [{"text": t, "grounding": ground(3, i, i + 1, PART), "confidence": c} for i, (t, c) in enumerate([("a", 0.5), ("b", None)])]
    assert got["relations"] == [{"kind": "section_start", "block_id": "text-0"}] and got["model_usage"] == {"m": {"input_tokens": 7}}
    empty = json.loads(export.wrapped_export(nodes, texts, words.limit(0), relations.limit(0), usage.limit(0)).first().json)
    assert (empty["words"], empty["relations"], empty["warnings"], empty["model_usage"], empty["engine"]) == ([], [], [], {}, None)


def test_cells_that_a_table_lacks(spark):
    rows = [("t", "table", 1, "<td>td</td><td>b</td>", None, None), ("c1", "table_cell", 2, "td", "t", None), ("c2", "table_cell", 3, "none", "t", 5), ("c3", "table_cell", 4, "b", "t", 7), ("c4", "table_cell", 5, "b", "gone", None)]
    c = spark.createDataFrame([(1, 1, *r, None) for r in rows], "doc_id int, page int, id string, type string, order int, markdown string, parent_id string, row int, col int")
    got = {r.id: (r.row, r.col, r.start, r.end, r.nested) for r in assemble.nest_cells(c).collect()}
    assert got == {"c1": (0, 0, 1, 3, True), "c2": (None, None, None, None, False), "c3": (7, 2, 15, 16, True)}
    t = spark.createDataFrame([(1, "t", "<td>td</td><td>b</td>", ["td", "x", "b"])], "doc_id int, id string, markdown string, cells array<string>")
    assert [(r.cell, r.violation) for r in assemble.cell_violations(t).collect()] == [(1, assemble.CELL_RULE)]


def test_words_and_lines_are_held_by_their_ranges(spark):
    texts = spark.createDataFrame([(1, "añb 😀 c")], "doc_id int, markdown string")
    words = spark.createDataFrame([(1, "ñ", 1, 2), (1, "😀", 4, 5), (1, "c", 5, 6)], "doc_id int, text string, start int, end int")
    assert [(r.text, r.violation) for r in assemble.word_violations(texts, words).collect()] == [("c", assemble.WORD_RULE)]
    blocks = spark.createDataFrame([(1, "a", 0, 3), (1, "b", 4, 9)], "doc_id int, id string, start int, end int")
    lines = spark.createDataFrame([(1, "a", 1, "añ", 0, 2), (1, "a", 2, "ñ", 1, 2), (1, "b", 1, "b", 2, 3)], "doc_id int, id string, line int, text string, start int, end int")
    got = sorted((r.id, r.violation) for r in assemble.atomic_violations(texts, blocks, lines).collect())
    assert got == sorted([("a", assemble.RANGE_RULES[3]), ("b", assemble.RANGE_RULES[0]), ("b", assemble.RANGE_RULES[2])])


def test_case_folding_is_that_of_unicode(spark):
    letters = [chr(c) for c in [*range(0x20, 0x2200), *range(0x2C00, 0x2E00), *range(0xA640, 0xABC0), *range(0xFB00, 0xFB18), *range(0xFF21, 0xFF5B), *range(0x10400, 0x10450)] if unicodedata.category(chr(c)) != "Cn"]
    words = [*letters, "ΑΣ", "ΣΑΣ ς", "İstanbul", "ﬁn STRASSE straße", "Œuvre", ""]
    got = {r.w: r.f for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", X.casefold(F.col("w")).alias("f")).collect()}
    assert {w: got[w] for w in words if got[w] != w.casefold()} == {}


def test_names_and_excerpts(spark):
    assert one(spark, X.safe_stem(F.lit("ﬁle①.pdf"))) == "file1" and one(spark, X.safe_stem(F.lit("Ｃｏｎ.txt"))) == "document-Con"
    t = "a <b>x &amp; y</b> &copy; &lt;z&gt; &unknown; &#233;"
    assert one(spark, X.plain_excerpt(F.lit(t))) == " ".join(html.unescape("a  x &amp; y  &copy; &lt;z&gt; &unknown; &#233;").split())
    assert one(spark, X.latin1(F.lit("aé€😀Ā"))) == "aé???"


def test_markup_that_is_shown(spark):
    dirty = '<h1>t</h1><p>a<script>x</script><a href="https://x">b</a><td colspan="2" onclick="y">c</td><acronym>d</acronym></p>'
    assert one(spark, X.shown_markdown(F.lit(dirty))) == 'tax<a>b</a><td colspan="2">c</td><acronym>d</acronym>'
    page = one(spark, X.standalone_html(F.lit("A <t>"), F.lit("<p>b</p>")))
    assert page.startswith("<!doctype html>") and "<title>A &lt;t&gt;</title>" in page and '<article class="paper"><p>b</p></article>' in page


def test_structured_values(spark):
    call = lambda name, args: json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"name": name, "arguments": args}}]}}]})
    said = lambda content: json.dumps({"choices": [{"message": {"content": content}}]})
    cases = [
        (call("s", '{"a": 1}'), {"a": 1}, None), (call("s", {"a": 2}), {"a": 2}, None), (call("other", "{}"), None, X.BAD_CALL), (call("s", "[1]"), None, X.NO_OBJECT), (said('```json\n{"b": "x"}\n```'), {"b": "x"}, None),
        (said('{"c": null}'), {"c": None}, None), (said("no json"), None, X.NO_OBJECT), (said(None), None, X.NO_CONTENT), ("{}", None, X.NO_MESSAGE), ('{"choices": []}', None, X.NO_MESSAGE), ('{"choices": ["x"]}', None, X.NO_MESSAGE),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, body string")
    got = {r.i: r.v for r in df.select("i", X.structured_value(F.col("body"), "s").alias("v")).collect()}
    for i, (_, value, error) in enumerate(cases):
        assert (got[i].value and json.loads(got[i].value), got[i].error) == (value, error), cases[i]
    assert one(spark, X.strip_fences(F.lit(" ```\nx\n``` "))) == "x" and one(spark, X.strip_fences(F.lit("``` x"))) == "``` x"


@pytest.mark.parametrize("size", [7, 40, 6000])
def test_context_is_the_end_of_all_pages_before(spark, size):
    rng = random.Random(8)
    rows = [(d, p, "x" * rng.choice([0, 0, 1, 3, 12, 90]) + str(p)) for d in range(3) for p in range(1, 40)] + [(9, p, "") for p in range(1, 9)]
    got = {(r.doc_id, r.page_seq): r.before for r in routing.with_context(spark.createDataFrame(rows, "doc_id int, page_seq int, text string"), size).collect()}
    assert got == {(d, p): "\n\n".join(t for e, q, t in rows if e == d and q < p)[-size:] for d, p, _ in rows}


def test_token_overlap_equals_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.8)) % 60}" for _ in range(4000)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(3, 25)))
    left = [(i, text()) for i in range(120)]
    right = [(i, text()) for i in range(60)] + [(100 + i, left[i][1] + " more words") for i in range(20)] + [(200, None), (201, "")]
    make = lambda rows: spark.createDataFrame(rows, "id int, text string")
    got = {(r.a, r.b): round(r.recall, 6) for r in quality.token_overlap(make(left), make(right)).collect()}
    want = {}
    for a, x in left:
        for b, y in right:
            x_, y_ = x.split(), (y or "").split()
            few = min(len(x_), len(y_))
            common = sum(min(x_.count(w), y_.count(w)) for w in set(x_))
            if few >= 5 and common >= 0.8 * few - 1e-9:
                want[a, b] = round(common / few, 6)
    assert got == want and len(want) >= 20


def test_archives_of_jobs(spark, tmp_path):
    """One archive a job, with a manifest of all its documents; the same files give the same bytes."""
    import json
    from zipfile import ZipFile

    from foliant.sources import archives

    rows = [("j1", 1, "a/x.pdf", "completed", None, "# md", None, b"%PDF", None, "{}"), ("j1", 2, "y.pdf", "failed", "broken", "md", "html", None, None, None)] + [(f"k{i}", 1, "n.pdf", "completed", "odd", f"text {i}", "<p>", None, "{}", None) for i in range(9)]
    df = spark.createDataFrame(rows, "job string, seq int, filename string, status string, error string, markdown string, html string, annotated_pdf binary, export_json string, ade_json string").repartition(4)
    for k in "ab":
        archives.write_archives(df, str(tmp_path / k))
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["j1.zip", *(f"k{i}.zip" for i in range(9))]
    assert all((tmp_path / "a" / p.name).read_bytes() == p.read_bytes() for p in (tmp_path / "b").iterdir())
    with ZipFile(tmp_path / "a" / "j1.zip") as z:
        assert z.namelist() == ["manifest.json", "01-x/x.ade-v2.json", "01-x/x.annotated.pdf", "01-x/x.md"] and z.read("01-x/x.md") == b"# md" and z.testzip() is None
        assert json.loads(z.read("manifest.json")) == {"version": 1, "documents": [
            {"source_filename": "a/x.pdf", "status": "completed", "error": None, "files": ["01-x/x.md", "01-x/x.annotated.pdf", "01-x/x.ade-v2.json"]}, {"source_filename": "y.pdf", "status": "failed", "error": "broken", "files": []}]}


def test_a_failed_write_leaves_no_archive(spark, tmp_path):
    from pyspark.sql import functions as F

    from foliant.sources import archives

    spark.dataSource.register(archives.Archives)
    rows = spark.range(40).select(F.concat(F.lit("job"), (F.col("id") % 8).cast("string")).alias("job"), "id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.encode(F.lit("data"), "utf-8").alias("data"))
    broken = rows.withColumn("seq", F.when(F.col("id") == 33, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id"))).select("job", "seq", "path", "data")
    with pytest.raises(Exception, match="killed"):
        broken.repartition(3, "job").sortWithinPartitions("job").write.format("archives").mode("append").save(str(tmp_path / "out"))
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    unsafe = spark.createDataFrame([("../up", 1, "a", b"x")], archives.SCHEMA)
    with pytest.raises(Exception, match="file name"):
        unsafe.write.format("archives").mode("append").save(str(tmp_path / "out"))


@pytest.mark.parametrize(
    "text,want",
    [
        ("# Report", "<h1>Report</h1>"), ("Title\n=====\n\nSub\n---\ntext", "<h1>Title</h1>\n<h2>Sub</h2>\n<p>text</p>"), ("one\ntwo\n\nthree", "<p>one\ntwo</p>\n<p>three</p>"), ("a  \nb", "<p>a<br>\nb</p>"), ("---\n***", "<hr>\n<hr>"),
        ("| Name | Value |\n| --- | :-: |\n| A | `1\\|2` |\n| B |", "<table>\n<thead>\n<tr>\n<th>Name</th>\n<th>Value</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>A</td>\n<td><code>1|2</code></td>\n</tr>\n<tr>\n<td>B</td>\n<td></td>\n</tr>\n</tbody>\n</table>"),
        ("* a\n* b\n\n1. c\n2. d", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ol>\n<li>c</li>\n<li>d</li>\n</ol>"), ("- a\n    - b\n    - c\n- d", "<ul>\n<li>a\n<ul>\n<li>b</li>\n<li>c</li>\n</ul>\n</li>\n<li>d</li>\n</ul>"), ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>"),
        ("> quoted\nmore\n\nnot", "<blockquote>\n<p>quoted\nmore</p>\n</blockquote>\n<p>not</p>"), ("```python\na < b\n\n# no\n```\nafter", "<pre><code>a &lt; b\n\n# no\n</code></pre>\n<p>after</p>"), ("    x = 1\n    y", "<pre><code>x = 1\ny\n</code></pre>"),
        ("**bold** *em* __b__ _e_ a_b_c ** x **", "<p><strong>bold</strong> <em>em</em> <strong>b</strong> <em>e</em> a_b_c ** x **</p>"), ("`*a*` \\*b\\* ``x`y``", "<p><code>*a*</code> *b* <code>x`y</code></p>"), ("a & b < c &amp; d", "<p>a &amp; b &lt; c &amp; d</p>"),
        ('[Source](https://example.com "T") ![pic](x.png) <https://e.org/?a=1&b=2>', '<p><a href="https://example.com" title="T">Source</a>  <a href="https://e.org/?a=1&amp;b=2">https://e.org/?a=1&amp;b=2</a></p>'), ("[bad](javascript:x) [**in**](/p_(1))", '<p><a>bad</a> <a href="/p_(1)"><strong>in</strong></a></p>'),
        ('<script>alert(1)</script><a href="javascript:alert(2)" onclick="alert(3)">link</a>', "alert(1)<a>link</a>"), ("", ""), ("text\n# H\n- x", "<p>text</p>\n<h1>H</h1>\n<ul>\n<li>x</li>\n</ul>"),
    ],
)
def test_markdown(text, want):
    from foliant.functions import markdown
    from foliant.functions.text import sanitized

    assert sanitized(markdown.rendered(text)) == want


def test_markdown_of_any_text_is_safe_and_whole(spark):
    """Random marks: nothing fails, no tag beyond the allowed ones comes out, and every word stays."""
    import random
    import re

    from foliant.functions import markdown
    from foliant.functions.text import ALLOWED_TAGS, sanitized

    rng = random.Random(2)
    plain = ["*", "**", "_", "`", "```\n", "#", "> ", "- ", "1. ", "|", "---", "\n", "\n\n", "    ", "&", "\\", "===", "]", ")"]
    for n in range(400):
        marks = plain if n % 2 else [*plain, "[", "](", "<b>", "</b>", "<script>", "<", "~~~"]
        text = "".join(rng.choice(marks) if rng.random() < 0.6 else f"word{rng.randrange(50)} " for _ in range(60))
        out = sanitized(markdown.rendered(text))
        assert {t.lower() for t in re.findall(r"</?([a-zA-Z][a-zA-Z0-9]*)", out)} <= ALLOWED_TAGS
        if n % 2 and "```" not in text and "|" not in text:
            assert set(re.findall(r"word\d+", text)) == set(re.findall(r"word\d+", out)), text
