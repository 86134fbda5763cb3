import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import fingerprint as fp
from foliant.llm.common import table

DATA = "/root/testdata/sf0.001"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_equals_brute_force():
    random.seed(1)
    a = [bytes(random.choices(b"ABCDab", k=random.randint(0, 64))) for _ in range(200)]
    b = [bytes(random.choices(b"ABCDab", k=random.randint(0, 64))) for _ in range(200)]
    assert fp.edit_distances(a, b).tolist() == [levenshtein(x, y) for x, y in zip(a, b, strict=True)]


def one_piece(text):
    """The fingerprint by its definition, a chunk at a time: ends by a rolling hash of seven bytes, a character for each chunk."""
    raw, gap = text.encode(), bytes(fp.WINDOW)
    at, level, _ = fp._scan(np.frombuffer(gap + raw, np.uint8))
    ends = [(e - fp.WINDOW, v) for e, v in zip(at.tolist(), level.tolist(), strict=True) if e > fp.WINDOW]
    k = max(fp.LEAST_K, (max(len(raw), 1) - 1).bit_length() - 6)
    while k > fp.LEAST_K and sum(v >= k for _, v in ends) < fp.FEWEST - 1:
        k -= 1
    out = []
    for least in (k, k + 1):
        cuts = [e for e, v in ends if v >= least][: fp.MOST - 1]
        cuts += [len(raw)] if (cuts[-1] if cuts else 0) < len(raw) else []
        chars = ""
        for a, b in zip([0, *cuts], cuts, strict=False):
            h = sum(x * pow(fp._MULT, i, 1 << 64) for i, x in enumerate(raw[a:b])) % 2**64
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            chars += chr(fp.ALPHABET[h >> 58])
        out.append(chars)
    return f"{k}:{out[0]}:{out[1]}"


def test_signatures_equal_brute_force():
    random.seed(4)
    texts = ["", "a", "ab" * 40, "".join(random.choices("abcdef gh", k=3000)), "x" * 900, " ".join(random.choices(["one", "two", "drei"], k=700))]
    assert fp.fingerprints(texts) == [one_piece(t) for t in texts]


@pytest.mark.parametrize("text", ["random", "a" * 300_000, "abc " * 80_000, "ab" * 3 + "x" * 200_000, "".join(chr(97 + i % 3) * (i % 50) for i in range(9_000))])
def test_long_texts_are_sliced_without_a_seam(monkeypatch, text):
    """Texts of little variety as well: one path gives what the other does."""
    random.seed(2)
    text = "".join(random.choices("abcdef gh", k=300_000)) if text == "random" else text
    whole = fp.fingerprints([text])[0]
    monkeypatch.setattr(fp, "SLICE_BYTES", 1 << 16)
    assert fp._long(text.encode()) == whole == fp.fingerprints([text])[0]


def test_place_in_a_batch_does_not_matter():
    texts = ["", "a", "some words " * 40, "x" * 5000, None, "some words " * 40]
    got = fp.fingerprints(texts)
    assert got == [fp.fingerprints([t])[0] for t in texts] and got[0] == got[4] and got[2] == got[5]


def test_local_edits_stay_near():
    random.seed(3)
    text = " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(800))
    other = " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(800))
    f, g, h = fp.fingerprints([text, text[:2000] + "INSERTED" + text[2000:], other])
    assert fp.likeness([f], [g])[0] > 0.9 and fp.likeness([f], [h])[0] < 0.3
    assert fp.likeness(["3:ab:a"], ["9:ab:a"])[0] == 0


@pytest.mark.parametrize("bounds", [[], [5], [1, 2, 3, 1000], [-(2**62), 0, 2**53 + 1, 2**53 + 3, 2**62], list(range(0, 900, 7))])
def test_buckets_equal_counts(spark, bounds):
    values = sorted({v + d for v in [*bounds, 0, 10**6, -5] for d in (-1, 0, 1)})
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", fp.bucket(F.col("v"), bounds).alias("n"))
    assert {r.v: r.n for r in df.collect()} == {v: sum(b <= v for b in bounds) for v in values}


def check_edits(rows, got, hashes=None):
    """Rows by id, descending, null last, then by the hash that the operator orders rows of one id by."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (hashes or {}).get(r[1], 0)))
    want = Counter()
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        f, e, x = fp.fingerprints([t, edited, nxt])
        want[k, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, fp.likeness([f], [e])[0], fp.likeness([f], [x])[0]] += 1
    assert Counter(map(tuple, got)) == want


def hashes_of(spark, texts):
    texts = list(texts)
    df = spark.createDataFrame(list(zip(texts, fp.fingerprints(texts), strict=True)), "text string, f string")
    return {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit("")), "f").alias("h")).collect()}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_hot_and_null_ids_and_repeated_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(fp, "RANGES", parts)
    rows = [(i % 7, f"text number {i} " * (i % 5)) for i in range(40)] + [(3, f"hot {i} " * 9) for i in range(60)] + [(None, f"none {i} " * 9) for i in range(40)]
    rows += [(None, "same " * 50)] * 30 + [(2**63 - 1, "top"), (-(2**63), "bottom"), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_edits(rows, fp.fingerprint_edits(df).collect(), hashes_of(spark, {t for _, t in rows}))


def test_query_equals_brute_force(spark):
    docs = table(spark, DATA, "documents")
    check_edits([tuple(r) for r in docs.select("doc_id", "text").collect()], fp.fingerprint_edits(docs).collect())


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_documents(spark, n):
    rows = [(i * 5, f"text number {i} " * 9) for i in range(n)]
    check_edits(rows, fp.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    got = fp.fingerprint_edits(odd_docs).collect()
    assert len(got) == odd_docs.count()
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    check_edits(rows, got, hashes_of(spark, {t for _, t in rows}))
    by = {r.doc_id: r for r in got}
    assert by[1].n_chars == 0 and by[1].fingerprint == by[2].fingerprint and by[5].fingerprint == by[6].fingerprint
    assert fp.fingerprint_edits(no_docs).count() == 0 and fp.document_fingerprints(no_docs).count() == 0
