"""Registered queries read the whole of their tables."""

import pytest
from pyspark.sql import functions as F

from foliant.plans import catalogue, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with large ids and texts of many lines and words, and 7,000 embeddings."""
    d = str(tmp_path_factory.mktemp("whole"))
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(25))
    spark.createDataFrame([(1, text), (70, text), (1_000_000, text + " end"), (None, text), (71, None)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    e.crossJoin(spark.range(14).withColumnRenamed("id", "k")).withColumn("vec_id", (F.col("vec_id") + F.col("k") * 500).cast(e.schema["vec_id"].dataType)).select(*e.columns).write.parquet(f"{d}/embeddings.parquet")
    return d


def test_page_queries_read_all_documents_and_texts(spark, small):
    run = lambda name: catalogue.queries()[name](spark, small)
    for name in ("suppress_duplicates", "merge_reconciled", "merge_figures", "agreement"):
        pages = {r.page.split(":")[0] for r in run(name).select("page").distinct().collect()}
        assert {"1", "70", "1000000"} <= pages, name
    merged = run("merge_reconciled").where("page like '1000000:%'").collect()
    assert {r.text for r in merged} == {" ".join(f"w{i}x{j}" for j in range(60)) + (" end" if i == 24 else "") for i in range(25)}


def test_regions_grow_with_the_input(spark, small):
    pages = catalogue.queries()["dedup_regions"](spark, small).groupBy("page").count().collect()
    assert len(pages) == 350 and max(r["count"] for r in pages) <= 20


def test_words_and_cells_are_those_of_whole_texts(spark, small):
    run = lambda name: catalogue.queries()[name](spark, small)
    grounded = run("ground_words").where("doc_id = 70")
    assert grounded.count() == 25 * 60
    assert run("nest_cells").where("doc_id = 70 and nested").count() == 25 * 60
    words = queries._worded(spark, small)
    assert words.where("size(boxes) <> 1500").count() == 1  # the text with one more word
    assert words.where("exists(boxes, b -> b.box.right > 1)").count() == 0
