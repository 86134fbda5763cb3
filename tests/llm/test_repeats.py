import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import neardup, queries, substring_dedup, suffix_dedup
from foliant.llm.common import table

DATA = "/root/testdata/sf0.001"
TIGHT = {"hot": 2, "held": 40, "local_rows": 300}


def brute_words(rows, size=35):
    """Every row is a document of its own; equal results are counted."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + size]) for _, w in words for k in range(len(w) - size + 1))
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    return out


def brute_bytes(rows, size=100):
    """Rows in the order of id, null last, and text hash."""
    seen, out = set(), Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if b[k : k + size] in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(b[k : k + size])
        out[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def both(df, **limits):
    w = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(substring_dedup.repeated_passages(df, **limits)).collect())
    b = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.later_copies(df, **limits)).collect())
    return w, b


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_equal_to_brute_force(spark, limits):
    df = table(spark, DATA, "documents").repartition(3)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    w, b = both(df, **limits)
    assert w == brute_words(rows) and b == brute_bytes(rows)
    assert sum(x[2] for x in w) and sum(x[2] for x in b)


def hard_rows():
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    hot = word(50)
    rows = [(i, " ".join(word(int(rng.integers(0, 60))) + hot[int(rng.integers(0, 10)) :] + word(int(rng.integers(0, 60))))) for i in range(80)]
    rows += [(100 + i, " ".join(hot)) for i in range(5)]
    rows += [(200, "la " * 300), (201, "la " * 120), (202, "abc" * 200), (203, " ".join(word(34))), (204, "é" * 120), (205, "x" * 99 + "é" * 99), (206, " ".join(hot + word(3) + hot)), (207, "z" * 100), (208, "z" * 100)]
    return rows


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_hot_passages_periods_and_edges(spark, limits):
    rows = hard_rows()
    w, b = both(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **limits)
    assert w == brute_words(rows) and b == brute_bytes(rows)


def test_long_texts_are_cut_without_a_seam(spark, monkeypatch):
    from foliant.llm import repeats

    rng = np.random.default_rng(12)
    text = " ".join(f"w{x}" for x in rng.integers(0, 5000, 4000))
    codes, kind = suffix_dedup.read(text).codes, suffix_dedup.kind_of()
    g = []
    for size in (len(codes), 2000):
        windows = set()
        for off in range(0, len(codes) - 99, size - 99):
            part = codes[off : off + size]
            h, c, lo, hi, a = repeats.segments(part, np.array([0, len(part)]), kind)
            for x, y, z, q in zip(h.tolist(), (lo + off).tolist(), (hi + off).tolist(), (a + off).tolist(), strict=True):
                windows |= {(s, x, q) for s in range(y, z + 1)}
        g.append(windows)
    assert g[0] == g[1] and len({s for s, _, _ in g[0]}) == len(codes) - 99


@pytest.mark.parametrize("length", [1, 3, 8, 12, 100])
def test_suffix_ranks_and_longest_previous_factors(length):
    rng = np.random.default_rng(13)
    data = rng.integers(1, 3, 300).astype(np.uint8)
    for n, rank in suffix_dedup.suffix_ranks(data, length):
        cut = [data[i : i + n].tobytes().ljust(n, b"\0") for i in range(len(data))]
        order = {c: i for i, c in enumerate(sorted(set(cut)))}
        assert [order[c] for c in cut] == np.unique(rank, return_inverse=True)[1].tolist()
    at, group = np.arange(300 - length + 1), np.sort(rng.integers(0, 3, 300 - length + 1))

    def common(i, j):
        return next((k for k in range(length) if data[i + k] != data[j + k]), length)

    want = [max((common(i, j) for j in range(i) if group[i] == group[j]), default=0) for i in at]
    assert suffix_dedup.longest_previous(data, at, group, length).tolist() == want


def test_previous_smaller_on_long_ways_back():
    value = np.array([5, 1, 2, 3, 4, 0, 9, 8, 7, 6, 2])
    common = np.array([0, 7, 6, 5, 9, 3, 8, 2, 4, 4, 1])
    want = [next((min(common[j + 1 : i + 1]) for j in range(i - 1, -1, -1) if value[j] < value[i]), 0) for i in range(len(value))]
    assert suffix_dedup.previous_smaller(value, common).tolist() == want


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_odd_rows(odd_docs, no_docs, limits):
    """Nulls, repeated ids and repeated rows included: all rows are compared."""
    w, b = both(odd_docs, **limits)
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert w == brute_words(rows) and b == brute_bytes(rows)
    assert both(no_docs) == ({}, {})


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_null_ids_and_one_id_with_several_texts(spark, limits):
    rng = np.random.default_rng(14)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared, short = word(50), word(60)
    texts = [(1, shared + word(20)), (None, shared + word(300)), (None, short), (None, word(40) + short), (7, word(30) + short + word(90)), (7, word(80)), (7, shared), (2**63 - 1, shared), (None, shared), (None, shared), (3, word(20)), (3, [])]
    texts += [(4, texts[1][1])] * 2 + [(5, word(200))] * 3
    rows = [(i, " ".join(t)) for i, t in texts]
    w, b = both(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **limits)
    assert w == brute_words(rows) and b == brute_bytes(rows)


ODD = [(None, "q " * 60 + "p1 " * 40), (None, "q " * 60), (1, "p1 " * 50), (2, "r " * 70), (2, "r " * 70), (2, "s" * 150), (None, None), (3, None), (3, "")]


@pytest.mark.parametrize("rows", [None, hard_rows(), ODD])
def test_sql_equals_brute_force(spark, rows):
    con = duckdb.connect()
    if rows is None:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    else:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert Counter(con.execute("SELECT doc_id, n_words, n_removed, kept_sha256 FROM (" + queries.OP4_SQL + ")").fetchall()) == brute_words(rows)
    assert Counter(con.execute("SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM (" + queries.OP9_SQL + ")").fetchall()) == brute_bytes(rows)


@pytest.mark.parametrize("limits", [{}, TIGHT])
def test_windows_of_any_length(spark, limits):
    """300 bytes and 200 words: offsets beyond seven bits."""
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared, passage = letters(700), words(450)
    df = spark.createDataFrame([(1, letters(300) + shared), (2, letters(300) + shared + letters(40)), (3, words(500) + " " + passage), (4, passage + " " + words(300))], "doc_id long, text string")
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in suffix_dedup.later_copies(df.where("doc_id < 3"), length=300, **limits).collect()}
    assert spans == {1: [], 2: [(300, 1000)]}
    found = {r.doc_id: r for r in substring_dedup.repeated_passages(df.where("doc_id > 2"), length=200, **limits).collect()}
    assert {k: (r.n_words, sum(x["end"] - x["start"] for x in r.spans)) for k, r in found.items()} == {3: (950, 450), 4: (750, 450)}
    with pytest.raises(ValueError):
        suffix_dedup.later_copies(df, length=70_000)


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "same text here", "a"), (1, "same text here", "b"), (2, "other words stand here", "c")], "doc_id long, text string, x string")
    odd = df.withColumns({c: F.col("x") for c in ("key", "_key", "none", "id", "row", "Text_", "doc_none", "doc_text", "_neardup_key_id")}).drop("x")
    rows = neardup.keep_one(odd).collect()
    assert [r.doc_id for r in sorted(rows)] == [1, 2] and all(len({*r[2:]}) == 1 and r[2] in "abc" for r in rows)
