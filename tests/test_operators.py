"""Literal cases of the operators, and invariants."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as X
from foliant.operators import align, assemble, jobs, organize, quality, reconcile, relations, usage

BOX = "struct<left:double,top:double,right:double,bottom:double>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("40-22-\n  17", "40-22-17"), ("foot-\r\nnote", "footnote"), ("a­​b  c\r\n d", "ab c d"), ("", ""), ("A-\nB", "A- B")])
def test_normalize_text(spark, given, want):
    assert one(spark, X.normalize_text(F.lit(given))) == want


def test_critical_tokens(spark):
    got = one(spark, X.critical_tokens(F.lit("Mail Ann@Example.org, see https://x.org/a. Call +1 (573) 751-3334; form AB-12 and INV#77.\n1. item")))
    assert {"ann@example.org", "https://x.org/a", "inv#77"} <= set(got)
    assert any(re.sub(r"\D", "", t) == "15737513334" for t in got)
    assert one(spark, X.critical_tokens(F.lit("plain words only"))) == []


@pytest.mark.parametrize(("given", "heading", "want"), [
    ("<strong>B</strong><BR />c", None, "**B**\nc"), ("Owner::", " owner ", ""), ("Owner\n  Jane", "OWNER", "Jane"), ("Owner:  Jane", "Owner", "Jane"), ("Owner Jane", "Owner", "Owner Jane"),
    ("Sum – Sum – 7", None, "Sum – 7"), ("<p>x</p>", "y", "x"), (None, "y", None), ("", "y", ""), ("A\u200bB", "", "AB"), ("a – b – a", None, "a – b – a"), ("Straße\nx", "STRASSE", "x"),
])
def test_labels(spark, given, heading, want):
    assert one(spark, X.clean_labels(F.lit(given).cast("string"), F.lit(heading).cast("string"))) == want


def test_labels_follow_the_last_heading_that_is_left(spark):
    rows = [(1, 1, "heading", "Name"), (1, 2, "text", "Name\nJohn"), (1, 3, "heading", "name:"), (1, 4, "text", "Name: "), (1, 5, "heading", "Age"), (1, 6, "text", "Name"), (2, 1, "text", "Name"), (2, 2, "text", None)]
    got = {(r.page, r.seq): r.clean for r in align.with_clean_labels(spark.createDataFrame(rows, "page int, seq int, type string, text string"), ["page"]).collect()}
    assert got == {(1, 1): "Name", (1, 2): "John", (1, 3): "", (1, 4): "", (1, 5): "Age", (1, 6): "Name", (2, 1): "Name", (2, 2): ""}


def test_sanitizer():
    dirty = '<p onclick="x()">a<script>alert(1)</script><a href="javascript:x">b</a><img src="https://x/y.png" onerror=z></p><iframe>c</iframe>'
    assert X.sanitized(dirty) == "<p>aalert(1)<a>b</a></p>c"


@pytest.mark.parametrize(("name", "want"), [("a/b/My File.pdf", "My-File"), ("CON.txt", "document-CON"), (".bashrc", "document"), ("clock$", "clock"), ("???", "document"), ("x" * 100 + ".md", "x" * 80)])
def test_safe_stem(spark, name, want):
    assert one(spark, X.safe_stem(F.lit(name))) == want


def test_boxes(spark):
    outer, inner = G.box(0.0, 0.0, 1.0, 1.0), G.box(0.2, 0.2, 0.4, 0.4)
    assert one(spark, G.overlap_over_smaller(outer, inner)) == 1.0
    got = one(spark, G.crop_to_page(G.box(0.2, 0.25, 0.8, 0.75), G.box(0.25, 0.2, 0.75, 0.8)))
    assert tuple(got) == (0.35, 0.35, 0.65, 0.65)
    assert tuple(one(spark, G.parse_model_box(G.box(100.0, 200.0, 300.0, 400.0)))) == (0.1, 0.2, 0.3, 0.4)
    for bad in ((0.5, 0.1, 0.2, 0.3), (float("nan"), 0.0, 1.0, 1.0), (-1.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1001.0, 5.0)):
        assert one(spark, G.parse_model_box(G.box(*bad))) is None


def test_assembly_slices_back(spark):
    rows = [("d", 1, 1, 1, "text", "title", "Café 😀"), ("d", 1, 1, 2, "table", None, "<td>x</td>"), ("d", 2, 3, 1, "text", None, ""), ("d", 3, 4, 1, "marginalia", None, "é\nz"), ("e", 1, 1, 1, "text", None, "only")]
    blocks = spark.createDataFrame(rows, "doc_id string, page_seq int, page int, ord int, type string, semantic_role string, markdown string")
    texts = {r.doc_id: r.markdown for r in assemble.document_text(blocks).collect()}
    ranged = assemble.with_ranges(blocks)
    for r in ranged.collect():
        assert texts[r.doc_id][r.start : r.end] == r.markdown
    assert texts["d"].endswith("<!-- doc_id=d -->") and texts["d"].count("PAGE BREAK") == 2
    assert {r.id for r in ranged.where("doc_id = 'd'").collect()} == {"text-1", "text-2", "table-1", "marginalia-1"}
    assert assemble.range_violations(ranged, assemble.document_text(blocks)).count() == 0
    broken = ranged.withColumn("end", F.col("end") + F.when(F.col("seq") == 1, 1).otherwise(0))
    assert broken.count() and assemble.range_violations(broken, assemble.document_text(blocks)).count() > 0


def test_place_prefers_cell_text(spark):
    got = one(spark, assemble.place(F.lit("<td>td</td><td>x</td>td"), F.array(F.lit("td"), F.lit("x"), F.lit("nope"), F.lit("td")), wrapped=True))
    assert [(g.text, g.start, g.end) for g in got] == [("td", 4, 6), ("x", 15, 16), ("td", 18, 20)]


def test_classes_first_match_wins(spark):
    pages = spark.createDataFrame([("d", 1, "An Invoice for travel"), ("d", 2, "nothing")], "doc_id string, page int, text string")
    got = {r.page: (r.label, r.reason) for r in organize.classify(pages, [("Trip", "travel plan"), ("Bill", "invoice")]).collect()}
    assert got == {1: ("Trip", "Matched source term: travel"), 2: ("Trip", organize.NO_MATCH)}
    with pytest.raises(ValueError):
        organize.classify(pages, [])


def test_continued_tables_only_between_neighbours(spark):
    t = spark.createDataFrame([("d", 1, 1, "a", 2), ("d", 1, 2, "b", 3), ("d", 2, 1, "c", 3), ("d", 4, 1, "e", 3)], "doc_id string, page_seq int, ord int, id string, columns int")
    got = relations.continued_tables(t).collect()
    assert [(r.from_id, r.to_id, r.column_count) for r in got] == [("b", "c", 3)]


def test_costs(spark):
    c = usage.model_cost(F.lit(2_000_000), F.lit(500_000), F.lit(3_000_000), F.lit(0.4), F.lit(1.5), F.lit(0.1))
    assert one(spark, F.round(c, 6)) == 5.15
    zero = usage.model_cost(F.lit(100), F.lit(1000), F.lit(0), F.lit(2.0), F.lit(1.0), F.lit(0.0))
    assert one(spark, F.round(zero, 9)) == 0.0002  # cached cut to the input; a price of zero means the input's
    assert one(spark, X.format_cost(F.lit(0.5))) == "$0.500000" and one(spark, X.format_cost(F.lit(7.25))) == "$7.2500"


def test_calibration(spark):
    assert one(spark, quality.calibrate(F.lit(0.5), [(0, 0.1), (1, 0.9)])) == 0.5
    assert one(spark, quality.calibrate(F.lit(-1.0), [(0, 0.1), (1, 0.9)])) == 0.1
    assert one(spark, quality.calibrate(F.lit(2.0), [(0, 0.1), (1, 0.9)])) == 0.9


def test_job_state_keeps_results_and_clears_errors(spark):
    log = spark.createDataFrame([("j", 1, "created", None, None), ("j", 2, "completed", None, "r"), ("j", 3, "failed", "boom", None), ("j", 4, "running", None, None)], "job_id string, seq int, event string, error string, result string")
    s = jobs.job_state(log.withColumns({"at": F.timestamp_seconds(F.col("seq").cast("long")), "checkpoint": F.lit(None).cast("long")})).first()
    assert (s.status, s.error, s.result) == ("running", None, "r")


def test_uncovered_ink(spark):
    px = spark.createDataFrame([(1, x, y, 0 if (x, y) in {(5, 5), (50, 50), (0, 0)} else 255) for x in range(100) for y in (0, 5, 50)], "page int, x int, y int, gray int")
    boxes = spark.range(1).select(F.lit(1).alias("page"), G.box(0.0, 0.0, 0.1, 0.1).alias("box"))
    pages = spark.createDataFrame([(1, 100, 100)], "page int, width int, height int")
    assert quality.uncovered_ink(quality.ink_runs(px, ["page"]), boxes, pages, ["page"]).first().uncovered == 0.5


def chunks(spark, *given):
    base = {"page": 1, "type": "text", "text": "", "status": "candidate", "exact": False, "left": 0.0, "top": 0.0, "right": 1.0, "bottom": 1.0, "score": 0.5, "parent_order": None, "source": "draft"}
    rows = [{"seq": i, **base, **k} for i, k in enumerate(given, 1)]
    ddl = "page int, seq int, type string, text string, status string, exact boolean, left double, top double, right double, bottom double, score double, parent_order int, source string"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in rows], ddl)


def test_suppression_prefers_status_then_length(spark):
    kept = lambda *c: [r.seq for r in reconcile.suppress_duplicates(chunks(spark, *c), ["page"]).orderBy("seq").collect()]
    a, b = {"text": "seven grey geese fly north again", "status": "verified"}, {"text": "seven grey geese fly north again!"}
    assert kept(a, b) == [1] and kept(b, a) == [2] and kept(b, a | {"status": "candidate"}) == [1]
    assert kept(a, b | {"left": 2.0, "right": 3.0}) == [1, 2] and kept(a, b | {"page": 2}) == [1, 2]
    long, short = {"text": "one two three four five six seven eight nine ten eleven twelve"}, {"text": "one two three four five"}
    assert kept(short, long) == [2] and kept(short | {"status": "verified"}, long) == [1, 2] and kept(short | {"type": "figure"}, long) == [1, 2]
    assert kept({"text": "one two three four"}, long) == [1, 2] and kept({"text": None}, {"text": ""}) == [1, 2]


def greedy(rows):
    """The same, one chunk after the other, from the statement of D1."""
    rank, kinds = {"verified": 2, "candidate": 1, "unresolved": 0}, reconcile.TYPE_RANK
    words = lambda r: re.findall(r"\w+", r.text)
    kept = []
    for c in rows:
        rivals = []
        for k in kept:
            x, y = sorted((c, k), key=lambda r: len(words(r)))
            near = min(len(c.text), len(k.text)) / max(len(c.text), len(k.text)) >= 0.8 and SequenceMatcher(None, c.text, k.text, autojunk=False).ratio() >= 0.95
            few = len(words(x))
            inside = few >= 5 and sum(min(words(x).count(w), words(y).count(w)) for w in set(words(x))) / few >= 0.8 and not {c.type, k.type} & {"figure", "chart"}
            longer, shorter = (c, k) if len(words(c)) >= len(words(k)) else (k, c)
            if near or inside and rank[longer.status] >= rank[shorter.status]:
                rivals.append((k, near))
        winner = c
        for k, near in rivals:
            worth = lambda r: (rank[r.status], r.exact, kinds[r.type], len(r.text), -r.seq) if near else len(words(r))  # noqa: B023, E731
            winner = k if worth(k) > worth(winner) else winner
        kept = [k for k in kept if all(k is not r for r, _ in rivals)] + [winner]
    return {r.seq for r in kept}


def test_suppression_equals_a_greedy_pass(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices("ant bee cat dog elk fox gnu hen".split(), k=rng.randint(6, 12))) for _ in range(4)]
    made = []
    for _ in range(60):
        w = rng.choice(base).split()
        w = w[: rng.randint(4, len(w))] + rng.choices(["", "", "owl"], k=1)
        made.append({"page": rng.randint(1, 4), "text": " ".join(filter(None, w)), "status": rng.choice(["verified", "candidate", "unresolved"]), "exact": rng.random() < 0.3, "type": rng.choice(["text", "list", "figure", "heading"])})
    df = chunks(spark, *made)
    got = {r.seq for r in reconcile.suppress_duplicates(df, ["page"]).collect()}
    rows = df.orderBy("seq").collect()
    want = set().union(*(greedy([r for r in rows if r.page == p]) for p in range(1, 5)))
    assert got == want and len(got) < 50


def test_region_dedup_keeps_the_better_in_place(spark):
    given = chunks(spark, {"score": 0.5}, {"left": 2.0, "right": 3.0}, {"score": 0.9}, {"score": 0.1})
    assert [(r.seq, r.score) for r in reconcile.dedup_regions(given, ["page"]).orderBy("seq").collect()] == [(2, 0.5), (3, 0.9)]
    assert [r.seq for r in reconcile.dedup_regions(given, ["page"], least_score=0.6).collect()] == [3]
    with pytest.raises(Exception, match="more than 3 regions"):
        reconcile.dedup_regions(given, ["page"], most=3).collect()


def test_merge_keeps_drafts_as_spine(spark):
    v = {"source": "verification"}
    given = chunks(
        spark, {"seq": 1, "text": "d1", "bottom": 0.2}, {"seq": 2, "text": "d2", "top": 0.5, "bottom": 0.7, "parent_order": 1}, {"seq": 1, "text": "v1", "bottom": 0.21, **v}, {"seq": 2, "text": "new", "type": "list", "top": 0.3, "bottom": 0.4, "parent_order": 1, **v},
        {"seq": 3, "text": "low", "type": "list", "top": None, "parent_order": 3, **v},
    )
    got = [(r.text, r.source, r.source_seq, r.parent) for r in reconcile.merge_reconciled(given, ["page"]).orderBy("position").collect()]
    assert got == [("v1", "verification", 1, None), ("new", "verification", 2, 1), ("d2", "draft", 2, 1), ("low", "verification", 3, None)]
    # a tie goes to the later draft
    tie = reconcile.merge_reconciled(chunks(spark, {"seq": 1, "text": "a"}, {"seq": 2, "text": "b"}, {"seq": 1, "text": "v", **v}), ["page"]).orderBy("position").collect()
    assert [r.text for r in tie] == ["a", "v"]


def test_figure_groups_replace_what_they_cover(spark):
    g = {"source": "group", "type": "figure"}
    given = chunks(spark, {"text": "a", "bottom": 0.1}, {"type": "figure", "text": "f1", "right": 0.3}, {"type": "chart", "text": "f2", "left": 0.5, "parent_order": 3}, {"text": "z", "top": 0.95, "parent_order": 2}, {"text": "g", **g}, {"text": "far", "top": 0.5, "left": 2.0, "right": 3.0, **g}, {"text": "not", "source": "group"})
    got = [(r.text, r.specialist, r.parent) for r in reconcile.merge_figures(given, ["page"]).orderBy("position").collect()]
    assert got == [("a", False, None), ("g", True, None), ("far", True, None), ("z", False, 2)]


def test_agreement_looks_at_normalised_texts(spark):
    ddl = f"page int, seq int, type string, text string, markdown string, box {BOX}"
    at = (0.0, 0.0, 1.0, 1.0)
    first = spark.createDataFrame([(1, 1, "text", "a\u200b" * 20, None, at), (1, 2, "text", " ", "only markdown here", at), (1, 3, "text", "call INV#77 now", None, at), (1, 4, "list", "same words", None, at), (1, 5, "text", "same words", None, None)], ddl)
    second = spark.createDataFrame([(1, 1, "text", "a" * 20, None, at), (1, 2, "text", "only markdown here.", None, at), (1, 3, "text", "call INV#78 now", None, at), (1, 4, "text", "same words", None, at)], ddl)
    assert {r.seq for r in reconcile.agreeing(first, second, ["page"]).collect()} == {1, 2}


def test_ocr_cleanup(spark):
    clean = lambda t: align.clean_ocr(spark.createDataFrame([(t,)], "t string"), "t", "x").first()["x"]
    assert clean("<|md_start|>p<|md_end|><|md_start|> p <|md_end|><|md_start|>q<|md_end|>") == "p\n\nq"
    assert clean("```html\ny\n```") == "y" and clean("a\n```\nb<|im_end|>") == "a\nb" and clean(None) is None and clean("") == ""
    long = "A long sentence of more than forty characters in all"
    assert clean(f"{long}\n{long}!\nAnswer the following question\nz") == long
    assert clean(f"{long}\n{long[:20]}X{long[20:]}\n{long[:39]}") == f"{long}\n{long[:39]}"
    assert clean("b\n\n\nc\nB") == "b\n\nc"


def test_alignment(spark):
    words = F.array(*[F.struct(F.lit(w).alias("text"), G.box(i / 10, 0.1, (i + 1) / 10, 0.2).alias("box")) for i, w in enumerate(["The", "«Quick»", "fox,", "the", "fox"])])
    assert one(spark, align.word_match(F.lit("quick FOX"), words)) == 1
    b = one(spark, align.aligned_box(F.lit("quick FOX"), words))
    assert (b.left, b.right) == (0.1, 0.3)
    assert one(spark, align.word_match(F.lit("missing"), words)) is None and one(spark, align.word_match(F.lit("..."), words)) is None


def overlap(a, b):
    wide, high = (max(0.0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    return wide * high / min((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))


def test_overlap_grid_equals_all_pairs(spark):
    random.seed(4)
    rows = []
    for i in range(120):
        x, y = random.random() * 0.8, random.random() * 0.8
        rows.append((i % 2, i, (x, y, x + random.random() * 0.2 + 0.01, y + random.random() * 0.2 + 0.01)))
    df = spark.createDataFrame(rows, f"page int, seq int, box {BOX}")
    got = {(r.a, r.b) for r in quality.overlapping_pairs(df, ["page"]).collect()}
    want = {(p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and overlap(p[2], q[2]) >= 0.5}
    assert got == want and want


def test_matching_is_the_ratio_of_matching_blocks():
    rng = random.Random(6)
    for _ in range(200):
        x, y = ("".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(2))
        assert reconcile.matching(x, y, 0.7) == (SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.7)


def test_results_do_not_depend_on_partitions(spark):
    from foliant.plans import catalogue

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(str, catalogue.queries()["merge_reconciled"](spark, "/root/testdata/sf0.001").collect())))
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_report_layout():
    lines = align.report_layout([(1, "word " * 200), (1, ""), (2, "x")])
    assert [x[3] for x in lines if "page" in x[3]] == ["Source page 1", "Source page 2"] and sum(x[0] == 0 for x in lines) == 5
    assert (1, 1, 88.0 + 22 + 14 + 48 + 12 + 14, "(empty block)") in lines
    assert max(p for _, p, _, _ in align.report_layout([(1, "a b c")] * 100)) > 4


def test_attempts_of_regions(spark):
    """One more attempt after nothing or a passing error; a page stops at another error, or at the third region in a row that was skipped."""
    a = lambda page, region, n, content="", status=None, family="deepseekocr", kind="text": (page, region, n, family, kind, content, status is not None, status, "http", "area", 5, 1)
    rows = [
        a("fine", 1, 1, "one"), a("fine", 2, 1), a("fine", 2, 2, "two"), a("fine", 3, 1, status=503), a("fine", 3, 2, "three"), a("fine", 4, 1, kind="figure"), a("fine", 5, 1, "x"), a("fine", 5, 2, "never made"),
        a("skips", 1, 1), a("skips", 1, 2), a("skips", 2, 1, status=429), a("skips", 2, 2, status=500), a("skips", 3, 1, "ok"), a("skips", 4, 1), a("skips", 4, 2),
        *[a("streak", r, n) for r in (1, 2, 3) for n in (1, 2)], a("streak", 4, 1, status=404),
        a("stop", 1, 1, "one"), a("stop", 2, 1, status=404), a("stop", 3, 1, "three"), a("other", 1, 1, "", family="glmocr"), a("other", 2, 1, "y", family="glmocr"), a("other2", 1, 1, status=503, family="glmocr"),
        a("nothing", 1, 1, " ", family="glmocr"), a("open", 1, 1), a("open", 2, 1, "z"),
    ]
    df = spark.createDataFrame(rows, "page string, region int, attempt int, family string, type string, content string, failed boolean, status int, kind string, label string, input_tokens long, output_tokens long")
    got = {r.page: (r.error, len(r.warnings), [c.content for c in r.chunks], r.input_tokens) for r in reconcile.attempted_pages(df, ["page"], "region").collect()}
    assert got == {
        "fine": (None, 0, ["one", "two", "three", "", "x"], 30), "skips": (None, 3, ["ok"], 25), "streak": (reconcile.STREAK_FAILED, 3, [], 30), "stop": (reconcile.REGION_FAILED.format("area", 2), 0, [], 5), "other": (None, 0, ["y"], 10),
        "other2": (reconcile.REGION_FAILED.format("area", 1), 0, [], 0), "nothing": (reconcile.NOTHING_READ, 0, [], 5), "open": (None, 0, ["z"], 10),
    }
