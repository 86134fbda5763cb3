import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import importance, queries

DATA = "/root/testdata/sf0.001"
SHOWN = ("doc_id", "n_features", "weight", "score", "rank")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def found(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target):
    """Rows ``doc_id, n_features, weight, score, rank`` by sorting all of them."""
    source = Counter(bucket(f) for _, t in docs for f in found(t)[1])
    wanted = Counter(bucket(f) for t in target for f in found(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000)))) for b in source}
    out = []
    for doc_id, text in docs:
        words, feats = found(text)
        weight = sum(gain[bucket(f)] for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


def drawn(docs, target, **more):
    return Counter(tuple(r[c] for c in SHOWN) for r in importance.resample(docs, target, **more).collect())


def by_sql(docs, target):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (text VARCHAR)")
    for name, rows in (("documents", docs), ("benchmark", [(t,) for t in target])):
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return Counter(con.execute(f"SELECT {', '.join(SHOWN)} FROM ({queries.OP12_SQL})").fetchall())


def test_given_tables(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    target = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    got = Counter(tuple(r[c] for c in SHOWN) for r in queries.op12_resample(spark, DATA).collect())
    assert got == brute(docs, target) == by_sql(docs, target)
    assert sum(1 for g in got if g[4]) > 20


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    target = ["word1 of1 word2 of2", None, "", "日本語 Ünïcödé ß text"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert drawn(odd_docs, goal) == brute(docs, target) == by_sql(docs, target)
    assert drawn(odd_docs, goal.limit(0)) == brute(docs, [])
    assert drawn(no_docs, goal) == Counter() == by_sql([], target)


def test_ties_and_repeated_rows(spark):
    """A hot id with its own texts and many copies around the last rank that is drawn."""
    text = lambda i: " ".join(f"w{i * j % 17}" for j in range(25))
    docs = [(5, text(i % 3)) for i in range(60)] + [(None, text(i % 4)) for i in range(40)] + [(i, text(i)) for i in range(100, 140)] + [(5, "few words")] * 4
    goal = spark.createDataFrame([("w1 w2 w3",)], "text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert drawn(df, goal) == brute(docs, ["w1 w2 w3"])
    again = drawn(df.repartition(2), goal)
    assert again == drawn(df, goal)


def test_parts_of_long_texts_are_one_text(monkeypatch):
    text = "Alpha beta-gamma  delta" + " word" * 50 + "; ümlaut x1 " + "y" * 300 + " end."
    whole = [(n, f.tolist()) for n, f in importance.features(text)]
    monkeypatch.setattr(importance, "PART", 7)
    parts = list(importance.features(text))
    assert len(whole) == 1 < len(parts)
    assert sum(n for n, _ in parts) == whole[0][0] and Counter(x for _, f in parts for x in f.tolist()) == Counter(whole[0][1]) == Counter(zlib.crc32(x.encode()) for x in found(text)[1])


@pytest.mark.parametrize("k", [1, 2, 17, 250, 499, 500])
def test_radix_selection_finds_the_key(spark, k):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.integers(-(2**63), 2**63 - 1, 500) >> rng.integers(0, 64, 500), rng.integers(-3, 3, 500)))]
    rows += []
    df = spark.createDataFrame(rows, "a long, b long, i long")
    for names in (["a", "i"], ["b", "a", "i"], ["b", "i"]):
        keys = [F.col(n) for n in names]
        want = sorted(rows, key=lambda r: [r["abi".index(n)] for n in names])[:k]
        last = importance.kth_key(df, keys, k)
        assert last == [want[-1]["abi".index(n)] for n in names][: len(last)]
        assert {r.i for r in df.where(importance.up_to(keys, last)).collect()} == {r[2] for r in want}
