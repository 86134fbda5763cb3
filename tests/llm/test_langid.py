import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import langid, queries

DATA = "/root/testdata/sf0.01"


def plain_grams(text):
    """Buckets of n-grams, one after the other."""
    data, out = langid.folded(text), []
    for n in langid.ORDERS:
        for i in range(len(data) - n + 1):
            g = data[i : i + n]
            if b"  " in g or 0 in g:
                continue
            h = 0
            for c in g:
                h = (h * 257 + c) % 2**32
            h = (h + n) * 0x9E3779B1 % 2**32
            out.append((h ^ h >> 15) % langid.BUCKETS)
    return out


def test_grams_and_margins_equal_plain_ones():
    rng = np.random.default_rng(1)
    texts = ["", "a", "Ünï cödé, 12 ß!", "one  two", "\0x\0", "日本語 😀", "X" * 50] + ["".join(rng.choice(list("ab é.\n"), 80)) for _ in range(20)]
    weights = rng.normal(size=(langid.BUCKETS, 7)).astype(np.float32)
    for t in texts:
        assert Counter(int(x) for _, b in langid.grams(langid.folded(t)) for x in b) == Counter(plain_grams(t))
    want = [weights[plain_grams(t)].astype(float).mean(axis=0) if plain_grams(t) else np.zeros(7) for t in texts]
    assert np.allclose(langid.margins(texts, weights), want, atol=1e-6)


def test_long_texts_in_parts_and_equal_texts():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(langid.BUCKETS, 600)).astype(np.float32)  # a slice has 4,096 bytes
    long = " ".join("".join(rng.choice(list("abcdé"), 6)) for _ in range(3000))
    got = langid.margins(["short text", long, "other", long], weights)
    assert np.allclose(got[1], weights[plain_grams(long)].astype(float).mean(axis=0), atol=1e-5) and (got[1] == got[3]).all()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 12, 40, 200])
def test_codewords_are_apart(n):
    code = langid.codebook(n)
    assert len(code) == n and (n < 2 or set(np.unique(code)) == {-1, 1})
    if n > 1:
        apart = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n < 3 else 2 ** (n - 2) if n <= langid.EXHAUSTIVE else 3)
        assert all(0 < (c == 1).sum() < n for c in code.T)


def test_decoding_mends_single_bits():
    """With any one of seven classifiers wrong, the right one of four languages is still nearest; brute force over codewords agrees."""
    code = langid.codebook(4)
    model = langid.Model(list("abcd"), code, None, np.full(code.shape, 1 / 7))
    for k in range(4):
        for wrong in range(7):
            m = code[k] * 0.5
            m[wrong] *= -1
            which, score, _ = langid.decoded(m[None, :], model)
            assert which[0] == k and 0.25 < score[0] <= 1
    rng = np.random.default_rng(3)
    m, trust = rng.normal(size=(200, 7)), rng.uniform(0.1, 1, (4, 7))
    which, score, close = langid.decoded(m, model._replace(trust=trust))
    for x, w, s in zip(m, which, score):
        loss = [sum(t * np.log2(1 + np.exp(-langid.STEEP * a * c)) for a, c, t in zip(x, row, tr)) for row, tr in zip(code, trust)]
        assert w == int(np.argmin(loss)) and 0 <= s <= 1
    assert 0 < close.sum() < 200
    assert langid.decoded(np.zeros((1, 7)), model)[2][0]


def test_held_out_documents_of_the_given_tables(spark):
    rows = queries.op13_langid(spark, DATA).collect()
    docs = {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, lang, text FROM '{DATA}/documents.parquet'").fetchall()}
    assert len(rows) == len(docs)
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(out) > 200
    wrong = [r for r in out if r.lang_pred != docs[r.doc_id][0]]
    assert len(wrong) <= 0.02 * len(out), [(r, docs[r.doc_id]) for r in wrong]
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 300")
    spoilt = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    said = lambda df: {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert said(docs) == said(spoilt)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not langid.has_letter(texts[r.doc_id])) and 0 <= r.score <= 1
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r.doc_id], set()).add((r.lang_pred, r.score))
    assert all(len(v) == 1 for v in by_text.values())
    assert langid.identify(no_docs).collect() == []
    none = spark.createDataFrame([(1, "some text", None), (3, "12 ½ Ⅷ", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}
    one = spark.createDataFrame([(i, f"text {i}", "") for i in range(8)] + [(9, "?", "de")], "doc_id long, text string, lang string")
    assert Counter(r.lang_pred for r in langid.identify(one).collect()) == {"": 8, "und": 1}
    many = spark.createDataFrame([(i, f"{chr(97 + i % 12) * 3} {chr(98 + i % 12) * 4} {i}", f"l{i % 12}") for i in range(240)], "doc_id long, text string, lang string")
    assert sum(r.lang_pred == f"l{r.doc_id % 12}" for r in langid.identify(many).collect()) == 240
