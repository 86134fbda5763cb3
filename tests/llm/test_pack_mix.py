import array
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import mixing, pack, queries, tokens
from foliant.llm.common import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_token_ids_equal_the_tokenizers(tokenizer):
    path = tokens.default_vocabulary()
    for t in ["", "a\x1cb  c", "x² ½ ³ y", "  \n\n  z", "don't I'll", "日本語 テスト 123", "“q” — … £5 ´` café_été_1", "𝔘 😀 a b", "\x85 \xa0x", " \t\x0b\x0c\r", "<|endoftext|>", "Ünïcödé ß", "w" * 300, "__a__  b"]:
        assert array.array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() == tokens.token_bytes(t, path)


def check_packing(rows, texts, tokenizer, capacity=1024):
    seq, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in texts.items():
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(docs[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(array.array("I", ids[at : at + r.length]).tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    return len(seq)


def test_query(spark, tokenizer):
    texts = dict(table(spark, DATA, "documents").select("doc_id", "text").collect())
    rows = queries.op7_packing(spark, DATA).collect()
    n = check_packing(rows, texts, tokenizer)
    assert n <= math.ceil(sum(r.length for r in rows) / 1024) * 1.03 + 1


def first_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, b in enumerate(bins):
            if b + n <= capacity:
                bins[i] += n
                break
        else:
            bins.append(n)
    return len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_whole_and_no_worse_than_first_fit(seed):
    import random

    rng = random.Random(seed)
    lengths = [rng.randint(1, 100) if seed % 2 else min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(400)]
    rows = pack.plan(Counter(lengths), 100)
    got, fill = Counter(), defaultdict(int)
    for n, a, b, uses, first, _ in rows:
        got[n] += b - a
        for r in range(b - a):
            fill[first + r // uses] += n
    assert got == Counter(lengths) and max(fill.values()) <= 100 and len(fill) <= first_fit(lengths, 100) + 1


def test_fullest_is_the_best_sum():
    import itertools

    counts = {3: 2, 5: 1, 7: 2, 11: 1}
    for room in range(40):
        best = max(sum(c) for k in range(7) for c in itertools.combinations([3, 3, 5, 7, 7, 11], k) if sum(c) <= room)
        uses = pack.fullest(counts, room)
        assert sum(n * k for n, k in uses.items()) == best and all(k <= counts[n] for n, k in uses.items())


def test_hot_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(pack, "GROUP", 50)
    df = spark.range(1000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, 100L, id % 40 + 1) as length", "id as ids_crc32")
    fill = defaultdict(list)
    for r in pack.placed(df, 128).collect():
        fill[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, fill.values())) == 1000
    for v in fill.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 128


def test_pack_odd_rows(spark, odd_docs, no_docs, tokenizer):
    """Repeated rows, and rows without an id, are packed once each: as many pieces of each kind as brute force has, in sequences without gaps."""
    extra = spark.createDataFrame([(None, "another one without an id"), (None, "no id here"), (9, "of the same id"), (2**63 - 1, "x" * 9000)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    rows = pack.pack(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.update((r.doc_id, *p) for p in pack.pieces_of(array.array("I", ids).tobytes(), 1024))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for places in fill.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024
    assert pack.pack(odd_docs.where("doc_id = 9")).count() == 2 and pack.pack(no_docs).count() == 0


def skewed(spark, n=600):
    return spark.range(n).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 10)) as source", "repeat('word ', cast(id % 7 + 1 as int)) as text", "'en' as lang", "id % 7 * 5 as n_chars")


def entropy(shares):
    return -sum(s * math.log(s) for s in shares)


def test_exponent_meets_its_target(spark):
    totals = {"a": 1000, "b": 100, "c": 50, "d": 10}
    df = spark.createDataFrame(list(totals.items()), "source string, tokens long")
    powers = lambda t: [x / sum(v**t for v in totals.values()) for x in (v**t for v in totals.values())]
    t = mixing.exponent(df, 0.8, 1e9)
    assert entropy(powers(t)) >= 0.8 * math.log(4) - 1e-9 and entropy(powers(t + 1e-5)) < 0.8 * math.log(4)
    t = mixing.exponent(df, 1.0, 2.0)
    assert 100 ** (1 - t) <= 2 + 1e-6 and 100 ** (1 - t + 1e-4) > 2
    assert mixing.exponent(df.limit(1)) == 1.0 and mixing.exponent(df.limit(0)) == 1.0


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_mixture_is_whole_and_within_budget(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block)
    docs = skewed(spark)
    rows = mixing.mix(docs).collect()
    assert {r.doc_id for r in rows if r.epoch == 0} == set(range(600)) and len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    weight, tokens_of, first = {}, Counter(), Counter()
    at = defaultdict(list)
    for r in rows:
        weight[r.source] = r.weight
        tokens_of[r.source] += r.tokens
        first[r.source] += r.tokens * (r.epoch == 0)
        at[r.source].append((r.position, r.tokens))
    assert abs(sum(weight.values()) - 1) < 1e-9
    total = sum(tokens_of.values())
    for s, w in weight.items():
        assert abs(tokens_of[s] / total - w) < 0.02 and tokens_of[s] <= 2 * first[s] + 1
        for (a, n), (b, _) in zip(sorted(at[s]), sorted(at[s])[1:], strict=False):
            assert a + n <= b or b >= first[s]  # no two stand in one place; an epoch ends where its last whole document does
    assert len({p for p, _ in at["hot"]}) == len(at["hot"])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mixed_rows_keep_every_document(spark, odd_docs, no_docs):
    docs = skewed(spark)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 600
    assert out.count() == mixing.mix(docs).count()
    odd = mixing.mixed_rows(odd_docs)
    assert odd.columns == odd_docs.columns and odd.select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count() and odd.count() >= odd_docs.count()
    assert mixing.mixed_rows(no_docs).count() == 0


def brute_mix(spark, docs, target=mixing.TARGET_ENTROPY, most_repeats=mixing.MOST_REPEATS):
    """The mixture a document at a time. Only hashes come from Spark."""
    seed, unit = mixing.SEED, 64**4
    at = lambda i, *c: F.xxhash64(*c, F.lit(seed + i))
    rows = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("print")).select("*", at(0, "doc_id", "print").alias("h"), *[at(1, "doc_id", "print", F.lit(e)).alias(f"e{e}") for e in range(4)]).collect()
    size = lambda t: max(1, len(re.findall(r"[^ \t-\r]+", t or "")))
    total = Counter()
    for r in rows:
        total[r.source] += size(r.text)
    whole = sum(total.values())

    def even(t):
        w = [(n / whole) ** t for n in total.values()]
        return round(-sum(x / sum(w) * math.log(x / sum(w)) for x in w), 9) >= round(target * math.log(len(w)), 9)

    if len(total) < 2:
        tau = 1.0
    else:
        low, high = 0, unit
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if even(mid / unit) else (low, mid - 1)
        a, b = 0, unit
        while a < b:
            mid = (a + b) // 2
            a, b = (a, mid) if (min(total.values()) / max(total.values())) ** (mid / unit - 1) <= most_repeats + 1e-12 else (mid + 1, b)
        tau = max(low, a) / unit
    top = max(total.values())
    raised = {s: (n / top) ** tau for s, n in total.items()}
    out = []
    for s, n in total.items():
        budget, blocks = max(n, math.floor(raised[s] * top + 0.5)), -(-n // mixing.BLOCK_TOKENS)
        order = {(r.b, e): r[f"o{e}"] for r in spark.range(blocks).select(F.col("id").alias("b"), *[at(2, "id", F.lit(e)).alias(f"o{e}") for e in range(4)]).collect() for e in range(4)}
        own = [r for r in rows if r.source == s]
        for epoch in range(-(-budget // n)):
            place = epoch * n
            for r in sorted(own, key=lambda r: (order[r.h % blocks, epoch], r.h % blocks, r[f"e{epoch}"], r.doc_id, r.print)):
                k = size(r.text)
                if epoch == 0 or place + k <= budget:
                    out.append((r.doc_id, s, k, round(raised[s] / sum(raised.values()), 9), epoch, place, round(place / budget, 9)))
                place += k
    return Counter(out)


@pytest.mark.parametrize(("block", "options"), [(1 << 20, {}), (40, {}), (40, {"target": 0.99, "most_repeats": 3.5}), (25, {"target": 0.5, "most_repeats": 1.2})])
def test_mixture_equals_brute_force(spark, monkeypatch, block, options):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block)
    docs = skewed(spark, 300).unionByName(spark.createDataFrame([(900, None, "no source", "en", 9), (901, "lone", None, "en", 0), (902, None, "x y z", "en", 5)], "doc_id long, source string, text string, lang string, n_chars long"))
    got = Counter((r.doc_id, r.source, r.tokens, round(r.weight, 9), r.epoch, r.position, round(r.place, 9)) for r in mixing.mix(docs, **options).collect())
    assert got == brute_mix(spark, docs, **options) and sum(got.values()) >= 303


def test_query_mixing(spark):
    docs = table(spark, DATA, "documents")
    rows = queries.op3_mixing(spark, DATA).collect()
    assert Counter((r.doc_id, r.source, r.tokens, round(r.weight, 9), r.epoch, r.position, round(r.place, 9)) for r in rows) == brute_mix(spark, docs)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
