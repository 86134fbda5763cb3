import array
import os
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from test_pack_mix import brute_mix
from test_secrets import brute_random
from test_simhash import groups_by_jaccard
from tokenizers import Tokenizer

import corpus_pipeline
from foliant.llm import pack, quality, secrets

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(path := f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(path)
        seen.append(docs.count())
        if i < 4:
            assert docs.columns == columns and docs.dtypes == before.dtypes
        if i == 2:
            assert all(not secrets.scan(r.text) for r in docs.collect()) and seen[-1] == seen[-2]
        if i == 3:
            assert docs.select("doc_id").distinct().count() == seen[-2]
        if i == 4:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert seen[0] > seen[1] > seen[2] and seen[4] >= seen[3]


def redacted(texts):
    """Texts without the spans of patterns and of the brute-force battery; overlapping spans are one."""
    out = []
    for t, more in zip(texts, brute_random(texts), strict=True):
        spans = []
        for a, b in sorted([*((a, b) for a, b, _ in secrets.base_spans(t)), *more]):
            if spans and a < spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        edges = [0, *(x for span in spans for x in span), len(t)]
        out.append("<secret>".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
    return out


def test_run_equals_brute_force(spark):
    """Each stage a document at a time; the classifier's models are its own, and so are hashes that order the mixture."""
    import public_tokenizers

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    abuse, scorer, _ = quality.train(docs, labels)
    judge = quality.Judge(abuse, scorer)
    rows = [r.asDict() for r in docs.collect() if judge(r.text)[1] <= quality.BAD_ABOVE]
    roots = groups_by_jaccard({r["doc_id"]: r["text"] for r in rows})
    rows = [r for r in rows if roots[r["doc_id"]] == r["doc_id"]]
    for r, t in zip(rows, redacted([r["text"] for r in rows]), strict=True):
        r["text"] = t
    mixture = brute_mix(spark, spark.createDataFrame([(r["doc_id"], r["source"], r["text"]) for r in rows], "doc_id long, source string, text string"))
    times = Counter()
    for (i, *_), n in mixture.items():
        times[i] += n
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        for p in pack.pieces_of(array.array("I", ids).tobytes(), 1024):
            want[r["doc_id"], *p] += times[r["doc_id"]]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for places in fill.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024
    assert len(fill) <= -(-sum(r.length for r in got) // 1024) * 1.03 + 1


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_rows(spark, odd_docs, no_docs, rows):
    """Nulls, repeated ids, clashing names and an empty table pass through all stages; names stay."""
    docs = odd_docs if rows == "odd" else no_docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if i < 4:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (out.count() > 0) == (rows == "odd")


def test_entry_lives_without_the_subpackage(tmp_path):
    """The other queries stay when the subpackage and the pipeline are gone."""
    for name in ("foliant", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "foliant/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op1') for n in q) and 'pipeline' not in q; print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
