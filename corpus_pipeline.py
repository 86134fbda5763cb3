"""The training-data pipeline: quality, near-duplicates, secrets, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to shared storage and reads them again for the next.

In every stage nulls in any column pass, a null text counts as empty, rows that repeat an id (or have none) are documents of their own, an empty
table gives an empty result, and columns of any name stay as they are. Ties are settled by the hash of id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import mixing, neardup, pack, quality, secrets
from foliant.llm.common import materialise, small_batches, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    small_batches(spark)
    return quality.keep_good(docs, quality.labels_of(spark, sf_dir))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id (null last) and text hash. Rows alike in both are one."""
    small_batches(spark)
    return neardup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes, and repeated rows stay."""
    small_batches(spark)
    return secrets.redact_secrets(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources below their target weight are repeated; every document stays. A null source is one of its own."""
    small_batches(spark)
    return mixing.mixed_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens, placed into sequences; repeated rows are packed once each."""
    small_batches(spark)
    return pack.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the fingerprints; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage{i}")
    return docs
