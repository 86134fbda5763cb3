"""What keeps queries within time and disk on large tables, and that their results are whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import bags
from foliant.functions.text import WORD, normalized_key
from foliant.operators import quality, reconcile
from foliant.plans import catalogue, queries

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Two orders of the same documents, of which some share an id or have none."""
    out = []
    rows = [(7, "\n".join(f"a {i}" for i in range(12))), (7, "\n".join(f"b {i}" for i in range(25))), (7, "a 0"), (None, "x\ny"), (None, "x\ny"), (8, None), (9, "")]
    for order in (rows, rows[::-1]):
        d = str(tmp_path_factory.mktemp("repeated"))
        spark.createDataFrame(order, "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
        spark.read.parquet(f"{DATA}/embeddings.parquet").write.parquet(f"{d}/embeddings.parquet")
        out.append(d)
    return out


def test_lines_are_shuffled_once_and_pages_merged_once(spark):
    plan = plan_of(catalogue.queries()["merge_reconciled"](spark, DATA))
    assert not [x for x in plan if "Filter" in x and "aggregate(" in x]
    joins = [x for x in plan_of(queries._page_chunks(spark, DATA)) if "Join" in x]
    assert len([x for x in joins if "vec" in x]) == 1 and len([x for x in joins if "page" in x]) == 1


def test_page_chunks_are_all_lines_twice(spark, repeated):
    chunks = queries._page_chunks(spark, repeated[0])
    got = sorted((r.page, r.seq, r.text) for r in chunks.collect())
    given = [(x.doc_id, x.text or "") for x in spark.read.parquet(f"{repeated[0]}/documents.parquet").collect()]
    hashed = {t: spark.range(1).select(F.sha2(F.lit(t), 256)).first()[0] for _, t in given}
    name = lambda k, t: str(k) if k is not None else f"text {hashed[t]}"
    assert got == sorted((f"{name(k, t)}:{i // 10}", 2 * i + c, line) for k, t in given for i, line in enumerate(t.split("\n")) for c in (0, 1))
    assert chunks.where("left is null").count() == 0


def test_merge_of_repeated_ids_has_one_result(spark, repeated):
    got = [sorted(map(str, catalogue.queries()["merge_reconciled"](spark, d).collect())) for d in repeated]
    assert got[0] == got[1] and got[0]


def shared(a, b):
    """Overlap over the smaller, as SQL has it: sides that are null are left out, nothing is above NaN."""
    rank = lambda v: (v != v, v)
    least, greatest = (lambda *x: min((v for v in x if v is not None), key=rank, default=None)), (lambda *x: max((v for v in x if v is not None), key=rank, default=None))
    less = lambda x, y: None if x is None or y is None else x - y
    side = lambda i: greatest(0.0, less(least(a[i + 2], b[i + 2]), greatest(a[i], b[i])))
    area = lambda x: None if None in x else (x[2] - x[0]) * (x[3] - x[1])
    small = least(area(a), area(b))
    return side(0) * side(1) / small if small else 0.0


@pytest.mark.parametrize("cell", [3, 8192])
def test_best_overlap_equals_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(quality, "CELL", cell)
    rng = random.Random(cell)

    def made(page, seq):
        x, y = rng.randrange(12) / 16, rng.randrange(12) / 16
        sides = [x, y, x + rng.randrange(5) / 16, y + rng.randrange(5) / 16]
        if page == 3:  # sides that are null, not a number, infinite or the wrong way round
            sides[rng.randrange(4)] = rng.choice([None, float("nan"), float("inf"), -1.0])
        return (page, seq, tuple(sides))

    a, b = ([made(i % 4, i % 50) for i in range(n)] for n in (70, 130))
    a, b = [*a, (8, 1, (0.0, 0.0, 1.0, 1.0)), (None, 1, (0.0, 0.0, 1.0, 1.0))], [*b, (9, 1, (0.0, 0.0, 1.0, 1.0)), (None, 1, (0.0, 0.0, 1.0, 1.0))]
    ddl = "page int, seq long, box struct<left:double,top:double,right:double,bottom:double>"
    got = {(r.page, r.candidate): (r.draft, r.overlap) for r in quality.best_overlap(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), ["page"]).collect()}
    pairs = [((p, c), (shared(x, y), d)) for p, c, x in a for q, d, y in b if p == q and p is not None]
    want = {k: max((v for key, v in pairs if key == k), key=lambda v: (v[0] != v[0], 0 if v[0] != v[0] else v[0], v[1])) for k, _ in pairs}
    assert {k: (d, str(abs(v))) for k, (d, v) in got.items()} == {k: (d, str(abs(v))) for k, (v, d) in want.items()} and len(want) > 60


def test_best_overlap_makes_no_row_of_a_pair(spark):
    rows = spark.range(3000).select(F.lit(1).alias("page"), F.col("id").alias("seq"), F.struct(*[F.lit(float(x)).alias(s) for x, s in zip((0, 0, 1, 1), ("left", "top", "right", "bottom"), strict=True)]).alias("box"))
    found = quality.best_overlap(rows, rows, ["page"])
    plan = plan_of(found)
    cells = next(i for i, x in enumerate(plan) if "MapInArrow" in x)
    assert not [x for x in plan[:cells] if "Join" in x]  # joins below it bring the number of cells alone
    assert [tuple(r) for r in found.groupBy("draft", "overlap").count().collect()] == [(2999, 1.0, 3000)]


def share(x, y):
    few = min(len(x), len(y))
    return sum(min(x.count(w), y.count(w)) for w in set(x)) / few if few >= 5 else 0.0


def test_bags_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(bags, "AT_ONCE", 7)
    rng = random.Random(3)
    for vocabulary in (4, 40, 400):
        made = lambda n: [rng.choices([f"w{i}" for i in range(vocabulary)], [1 / (i + 1) for i in range(vocabulary)], k=rng.randint(5, 40)) for _ in range(n)]  # noqa: B023, E731
        own, others = made(40), made(60)
        others += [x + x[:1] for x in own[:9]] + [x[1:] + ["unknown"] for x in own[9:18]]
        count = lambda x: {w: x.count(w) for w in x}
        a, b, got = bags.Bags([(list(count(x)), list(count(x).values())) for x in own]).sharing([count(x) for x in others], 0.8)
        want = {(i, j): share(x, y) for i, x in enumerate(others) for j, y in enumerate(own) if min(len(x), len(y)) >= 5 and share(x, y) >= 0.8}
        assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), got.tolist(), strict=True)) == want and len(a) == len(want) >= 9
    assert not len(bags.Bags([]).sharing([{"a": 5}], 0.8)[0]) and not len(bags.Bags([(["a"], [5])]).sharing([], 0.8)[0])


def test_words_are_those_of_the_normalised_key(spark):
    odd = ["co-\n operate 12-\r\n34 x-\ty", "a­b​c", "Straße İstanbul ΣΊΣΥΦΟΣ ſo ﬁne ŉ ǰ", "一二 ½ Ⅷ ² _a_b áé", "x\x1cy\x85z w", "", "--\n- \n", "tail-\nA head-\nb"]
    texts = odd + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.words for r in df.select("i", F.regexp_extract_all(normalized_key(F.col("text")), F.lit(WORD), F.lit(0)).alias("words")).collect()}
    assert got == {i: bags.words(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("part", "swapped"), [(1 << 19, False), (30, False), (30, True)])
def test_token_overlap_in_parts_and_with_repeated_ids(spark, monkeypatch, part, swapped):
    monkeypatch.setattr(quality, "BAG_WORDS", part)
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randint(2, 15)))
    many = [(i % 70, text()) for i in range(90)] + [(None, "w1 w2 w3 w4 w5")]
    few = [(i, t) for i, t in many[20:40] if i is not None] + [(21, "w1 w1 w1"), (200, None), (None, "w1 w2 w3 w4 w5"), (201, "w1 W2-\n w3"), (202, "")]
    if swapped:
        many, few = few, many
    make = lambda rows: spark.createDataFrame(rows, "id int, text string")
    found = quality.token_overlap(make(many), make(few))
    assert not [x for x in plan_of(found) if "word" in x and "Join" in x]
    whole = lambda rows: {i: [w for j, t in rows if j == i for w in bags.words(t or "")] for i, _ in rows if i is not None}
    want = {(a, b): share(x, y) for a, x in whole(many).items() for b, y in whole(few).items() if min(len(x), len(y)) >= 5 and share(x, y) >= 0.8}
    assert {(r.a, r.b): r.recall for r in found.collect()} == want and len(want) >= 20


def test_keys_are_those_of_the_normalised_key(spark):
    odd = [" a  b ", "co-\n operate 12-\r\n34\tx", "a­​b", "Straße ΣΊΣΥΦΟΣ ﬁne", "x\x1cy\x85z\xa0w　v\x0bu", "", "\n", "a \r\n b\rc", "--\n- \nA", "﻿ lead"]
    texts = odd + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").collect()]
    got = {r.i: r.k for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", normalized_key(F.col("text")).alias("k")).collect()}
    assert got == {i: bags.key(t) for i, t in enumerate(texts)}


def test_chunks_of_pages_are_told_alike_in_any_parts(monkeypatch):
    rng = random.Random(7)
    base = [" ".join(rng.choices("ant bee cat dog elk fox gnu hen".split(), k=rng.randint(5, 12))) for _ in range(4)]
    pages = []
    for p in range(30):
        n = rng.randint(0, 12)
        text = [rng.choice([None, "", *(b + rng.choice(["", " owl", "."]) for b in base)]) for _ in range(n)]
        sides = [[rng.choice([0.0, 0.2, float("nan") if rng.random() < 0.1 else 0.1]), 0.0, rng.choice([0.5, 0.7]), 1.0] for _ in range(n)]
        seq = [rng.choice([None, i, i // 2]) if p % 5 == 0 else i for i in range(n)]
        pages.append((seq, rng.choices(["text", "list", "figure", None], k=n), text, rng.choices(["verified", "candidate", "other", None], k=n), rng.choices([True, False, None], k=n), np.array(sides).reshape(-1, 4).T))
    numbers = np.repeat(np.arange(len(pages)), [len(p[0]) for p in pages])
    together = [[x for p in pages for x in p[c]] for c in range(5)]
    alone = [k for p in pages for k in reconcile.kept_chunks(np.zeros(len(p[0]), np.int64), *p)]
    assert reconcile.kept_chunks(numbers, *together, np.concatenate([p[5] for p in pages], 1)) == alone
    monkeypatch.setattr(bags, "AT_ONCE", 5)
    assert reconcile.kept_chunks(numbers, *together, np.concatenate([p[5] for p in pages], 1)) == alone and 20 < alone.count(False) < len(alone)


def test_suppression_makes_no_row_of_a_pair(spark):
    text = "seven grey geese fly north again"
    rows = [(p, i, "text", text, "candidate", True, 0.0, 0.0, 1.0, 1.0, f"{p} {i}") for p in (1, 2, None) for i in range(30)] + [(2, None, "text", text, None, None, 0.0, 0.0, 1.0, 1.0, "x"), (2, 40, None, None, None, None, None, None, None, None, "y")]
    df = spark.createDataFrame(rows, "page int, seq int, type string, text string, status string, exact boolean, left double, top double, right double, bottom double, more string")
    found = reconcile.suppress_duplicates(df, ["page"])
    assert not [x for x in plan_of(found) if "Join" in x] and found.columns == df.columns
    want = [(1, 0, "1 0"), (2, 0, "2 0"), (2, 40, "y"), (2, None, "x"), *[(None, i, f"None {i}") for i in range(30)]]
    assert sorted(map(str, ((r.page, r.seq, r.more) for r in found.collect()))) == sorted(map(str, want))
