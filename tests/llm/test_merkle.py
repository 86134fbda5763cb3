import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from foliant.llm import merkle, queries

DATA = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute(rows):
    """Rows ``doc_id, source, lang, n_chars, text``, by plain lists."""

    def grow(level, proofs, folds):
        """``level``: digests; ``proofs`` and ``folds``: of each leaf, as ``[node, ...]`` lists that are changed in place."""
        while len(level) > 1:
            runs = [level[i : i + 8] for i in range(0, len(level), 8)]
            for p in proofs:
                run, at = runs[p[0] // 8], p[0] % 8
                p[1] += "".join(run[:at] + run[at + 1 :])
                p[2] = sha(*run[:at], p[2], *run[at + 1 :])
                p[0] //= 8
            level = [sha(*r) for r in runs]
        return level[0]

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    subroots, all_proofs = [], []
    for lang in sorted(groups, key=lambda v: (v is not None, (v or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r)))
        leaves = [leaf_of(r) for r in own]
        told = [leaf_of((*r[:4], lower(r[4]))) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else x for r, x in zip(own, leaves)]
        proofs = [[i, "", t] for i, t in enumerate(told)]
        subroots.append(grow(leaves, proofs, None))
        all_proofs.append((own, leaves, proofs))
    for k, (_, _, proofs) in enumerate(all_proofs):
        for p in proofs:
            p[0] = k
    root = grow(subroots, [p for *_, proofs in all_proofs for p in proofs], None) if subroots else None
    return Counter((r[0], x, s, root, sha(p[1]), p[2], p[2] == root) for s, (own, leaves, proofs) in zip(subroots, all_proofs) for r, x, p in zip(own, leaves, proofs))


def told(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in merkle.digest(merkle.manifest(df)).collect())


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.OP11_SQL})").fetchall())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(sizes):
    out, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            out.append((n * 7 % 1009, f"s{n % 3}", lang, n, f"Text NUMBER {n} é" if n % 11 else None))
            n += 1
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "de": 1}, {"en": 64, None: 65, "": 7, "fr": 2}, {"a": 700, "b": 3, "Ü": 17, "z": 1}, {f"g{i:02}": i % 5 + 1 for i in range(70)}])
def test_sizes_of_trees(spark, sizes):
    rows = made(sizes)
    want = brute(rows)
    assert told(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want == by_sql(rows)
    assert len({w[3] for w in want}) == 1


def test_low_blocks_need_several_steps(spark, monkeypatch):
    """With blocks of one level, a tree of 700 leaves takes four steps down; the functions carry HEIGHT with them as they are made."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    rows = made({"a": 700, "b": 60, None: 1, "c": 8, "d": 64})
    assert told(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_parents_complete_in_any_order_of_events(spark):
    rows = [(0, 500, i * 37 % 500, bytes([i % 256] * 32)) for i in range(500)]
    df = spark.createDataFrame(rows, "tree long, leaves long, place long, data binary")
    root = lambda f: [(r.tree, r.level, r.data) for r in f.roots.collect()]
    one, many = merkle.forest(df.repartition(4)), merkle.forest(df.orderBy("place").coalesce(1))
    assert root(one) == root(many) and len(root(one)) == 1
    assert one.links.count() == many.links.count() == 63 + 8 + 1


def test_given_tables(spark):
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{DATA}/documents.parquet'").fetchall()
    got = Counter(tuple(r[c] for c in COLUMNS) for r in queries.op11_manifest(spark, DATA).collect())
    assert got == brute(rows) == by_sql(rows)
    changed = [w for w in got if not w[6]]
    assert changed and len(changed) < len(got)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert told(odd_docs) == brute(rows) == by_sql(rows)
    assert told(no_docs) == Counter() == by_sql([])
    null = [(None, None, None, None, None)] * 3
    assert told(spark.createDataFrame(null, SCHEMA)) == brute(null) == by_sql(null)


def test_paths_prove_rows_by_themselves(spark):
    """A reader with a row, its path and the root alone can check it."""
    rows = made({"en": 100, "de": 20})
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert merkle.folded(bytes(r.leaf), bytes(r.path)) == bytes(r.root)
        assert merkle.folded(b"\0" * 32, bytes(r.path)) != bytes(r.root)
