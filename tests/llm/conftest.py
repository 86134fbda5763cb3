import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a long text, ties, repeated rows, and extra columns whose names the operators use inside."""
    long = " ".join(f"word{i % 977} of{i % 13}" for i in range(30_000))
    shared = " ".join(f"passage{i}" for i in range(60))
    rows = [
        (1, None, "en", None, None, "x"), (2, "", "en", "a", 0, None), (3, " \t\n ", None, "a", 4, "x"), (4, "one", "en", "b", 3, "x"), (5, long, "en", "b", len(long), "x"), (6, long, "en", "b", len(long), "x"),
        (7, f"start {shared} end of seven", "en", "c", 1, "x"), (8, f"other begin {shared} tail", "en", None, 1, "x"), (9, "Ünïcödé ß 日本語 😀 text \u00a0 nbsp\u2028line", "de", "c", 5, "x"), (9, "Ünïcödé ß 日本語 😀 text \u00a0 nbsp\u2028line", "de", "c", 5, "x"),
        (None, "no id here", "en", "c", 10, "x"), (10, "a" * 500, "en", "d", 500, "x"), (11, "ab " * 200, "en", "d", 600, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    clash = ("fp", "g", "c", "at", "doc", "part", "ghost", "id", "node", "root", "epoch", "block", "tokens", "weight", "length", "piece", "spans", "features", "pattern", "judgement", "print", "s", "u", "v", "key", "row", "none", "doc_none", "doc_text", "_neardup_key_id", "tree", "level", "leaf", "number", "rank", "h", "score", "n_features", "held_out", "lang_pred", "digest", "kids")
    return df.withColumns({c: F.lit(7) for c in clash} | {"_neardup_key_id": F.lit("kept")}).coalesce(2).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
