import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import neardup, queries, simhash
from foliant.llm.common import table
from foliant.llm.components import components

DATA = "/root/testdata/sf0.001"


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_bk_tree_finds_all_within_radius():
    random.seed(8)
    base = [random.getrandbits(64) for _ in range(40)]
    values = list({b ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(10)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:60]:
        assert sorted(tree.near(v, 2)) == sorted(x for x in values if (x ^ v).bit_count() <= 2)


@pytest.mark.parametrize(("shard", "radius"), [(simhash.SHARD, 2), (5, 2), (0, 2), (5, 1), (7, 3)])
def test_links_connect_what_brute_force_does(spark, monkeypatch, shard, radius):
    """Also where shards are dealt more finely."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    random.seed(9)
    base = [random.getrandbits(64) for _ in range(30)]
    base += [base[0] & ~0xFFFF | random.getrandbits(16) for _ in range(20)]
    values = [b ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for b in base for _ in range(12)] + base
    want, got = Sets(), Sets()
    for a, b in itertools.combinations(set(values), 2):
        if (a ^ b).bit_count() <= radius:
            want.join(a, b)
    rows = spark.createDataFrame([(simhash.signed(v),) for v in values], "fingerprint long").repartition(5)
    for r in simhash.fingerprint_links(rows, radius).collect():
        a, b = r.u & (2**64 - 1), r.v & (2**64 - 1)
        assert (a ^ b).bit_count() <= radius
        got.join(a, b)
    assert {v: want.find(v) for v in values} == {v: got.find(v) for v in values}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks(radius):
    masks = [m & (2**64 - 1) for m in simhash.block_masks(radius)]
    assert sum(masks) == 2**64 - 1 and len(masks) == radius + 1
    assert all(bin(m & (2**64 - 1)).count("1") == 64 - 8 * radius for m in simhash.fine_masks(radius)) and len(set(simhash.fine_masks(radius))) == len(simhash.fine_masks(radius))


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_union_find(spark, seed):
    random.seed(seed)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (None, 3)]
    sets = Sets()
    for a, b in edges:
        if a is not None:
            sets.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: sets.find(x) for x in sets if sets.find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def check_components(rows, got):
    sets, prints = Sets(), {i: brute_print(t) for i, t in rows}
    for i in prints:
        sets.find(i)
    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            sets.join(a, b)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {i: (f"{p:016x}", sets.find(i)) for i, p in prints.items()}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    got = queries.op10_simhash(spark, DATA).collect()
    assert len(got) == len(rows)
    check_components(rows, got)


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = simhash.simhash_components(odd_docs).collect()
    assert len(got) == len(rows)
    check_components([r for r in rows if r[0] is not None], got)
    assert simhash.simhash_components(no_docs).count() == 0


def groups_by_jaccard(texts):
    sh = {i: frozenset(simhash.shingle_hashes(simhash.words_of(t), 5).tolist()) for i, t in texts.items()}
    sets = Sets()
    for i in sh:
        sets.find(i)
    for a, b in itertools.combinations(sh, 2):
        union = len(sh[a] | sh[b])
        if not union or len(sh[a] & sh[b]) / union >= 0.8:
            sets.join(a, b)
    return {i: sets.find(i) for i in sh}


def test_near_duplicates_equal_brute_force(spark):
    docs = table(spark, DATA, "documents")
    roots = groups_by_jaccard(dict(docs.select("doc_id", "text").collect()))
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    assert kept == set(roots.values())


def test_near_copies_are_found_and_others_stay(spark):
    rng = random.Random(10)
    vocab = [f"v{i}" for i in range(3000)]
    texts, k = {}, 0
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 400))]
        for _ in range(4):
            w = list(base)
            for _ in range(max(1, len(w) // 100)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts[k] = " ".join(w)
            k += 1
    roots = groups_by_jaccard(texts)
    kept = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    assert set(roots.values()) <= kept and len(kept - set(roots.values())) <= 1


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_near_copies_in_many_groups_of_one_template(spark, monkeypatch, block):
    """120 documents share most words, at a similarity just under 0.8; each has a near copy."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block, raising=False)
    rng = random.Random(11)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, texts = word(180), {}
    for i in range(120):
        own = word(26)
        texts[i] = " ".join(template + own)
        texts[500 + i] = " ".join(template + own + word(3))
    roots = groups_by_jaccard(texts)
    assert len(set(roots.values())) == 120
    kept = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    assert kept == set(roots.values())


def test_alike_pairs_connect_what_brute_force_does():
    rng = np.random.default_rng(12)
    base = [rng.integers(0, 1 << 40, 60) for _ in range(6)]
    sets = [np.unique(np.append(rng.permutation(base[i % 6])[: rng.integers(48, 61)], rng.integers(0, 1 << 40, 2))) for i in range(60)]
    pack = lambda v: v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : neardup.WIDTH].tobytes()
    hashes, nodes = [pack(v) for v in sets], np.arange(60)
    apart = np.array([1 - neardup.jaccard(hashes[0], h) for h in hashes])
    want, got = Sets(), Sets()
    for a, b in itertools.combinations(range(60), 2):
        if neardup.jaccard(hashes[a], hashes[b]) >= 0.8:
            want.join(a, b)
    for blocks in (np.zeros(30, int), np.ones(30, int)):
        pick = nodes[:30] if not blocks.any() else nodes[30:]
        for a, b in neardup.alike_pairs(pick, blocks, apart[pick], [hashes[i] for i in pick]):
            got.join(a, b)
    for a, b in neardup.alike_pairs(nodes, nodes // 30, apart, hashes):
        got.join(a, b)
    for i in range(1, 60):
        if 1 - apart[i] >= 0.8:
            got.join(0, i)
    assert {i: want.find(i) for i in range(60)} == {i: got.find(i) for i in range(60)}


def test_long_unlike_texts_are_not_alike():
    rng = np.random.default_rng(17)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10**9, 200_000)) for _ in range(2))
    assert neardup.jaccard(neardup.short_hashes(a), neardup.short_hashes(b)) < 1e-4
    assert neardup.jaccard(neardup.short_hashes(a), neardup.short_hashes(a)) == 1


def test_keep_one_on_odd_rows(spark, odd_docs, no_docs):
    out = neardup.keep_one(odd_docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd_docs.columns and None in ids
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 9, 10, 11]  # 7 and 8 share 56 of 63 shingles
    assert neardup.keep_one(no_docs).count() == 0
    assert neardup.keep_one(odd_docs.where(F.col("doc_id").isNull())).count() == 1


def test_keep_one_of_repeated_and_missing_ids(spark):
    """Texts of one id, or without one, are documents of their own: none is lost but to a near-duplicate."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b c d e f", "x"), (1, "g h i j k l", "x"), (1, "g h i j k l", "y"), (None, "m n o p q r", "x"), (None, long, "x"), (2, long + " end", "x"), (None, "m n o p q r", "z"), (None, None, "x"), (None, "", "x"), (2**63 - 1, "s t u v w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id, r.text or "") for r in neardup.keep_one(docs).collect())
    assert got == sorted((i is None, i, t) for i, t in [(1, "a b c d e f"), (1, "g h i j k l"), (None, "m n o p q r"), (2, long + " end"), (None, ""), (2**63 - 1, "s t u v w")])
    assert sorted(map(str, neardup.keep_one(docs).collect())) == sorted(map(str, neardup.keep_one(docs.repartition(5)).collect()))
