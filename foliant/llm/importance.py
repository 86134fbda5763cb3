"""Importance resampling towards a target: documents drawn in proportion to how likely hashed word features make them under the target.

Features of all documents and of the target are counted in hashed buckets; the gain of a bucket is the log ratio of the two, and a document's
weight the mean gain of its features, read from one array. A Gumbel draw for each id turns weights into scores, so that the highest scores are a
draw without replacement. The last score that is in is found exactly, by radix selection: digit by digit of the composite key (score, id, text,
row), histograms of one digit tell in which the wanted rank lies. Only rows up to that key are range-sorted and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, dealt_in_order, materialise, sliced, with_positions

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bits of a digit of a key: a histogram has at most 2 ** DIGIT rows.
DIGIT = 12
#: Bytes of text that become words at one time.
PART = 1 << 20
#: Letters and digits of ASCII in lower case and all bytes beyond it are words; the rest is blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """Words, and CRC-32 of all features that end in them, of a text in parts: each word, and each pair of consecutive words joined by a blank."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
    start, before = 0, None
    while start < len(data):
        cut = data.find(b" ", start + PART)
        cut = len(data) if cut < 0 else cut
        words = data[start:cut].split()
        start = cut
        if not words:
            continue
        ones = list(map(crc32, words))
        follow = words if before is not None else words[1:]
        # the checksum of a pair goes on from that of its first word
        twos = list(map(crc32, map(b" ".__add__, follow), ones if before is None else [before, *ones]))
        before = ones[-1]
        yield len(words), np.array(ones + twos, np.uint32)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all buckets in a task's texts."""
    seen = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for a, b in sliced(pc.binary_length(batch.column(0)).fill_null(0).to_pylist()):
            found = [f % np.uint32(BUCKETS) for t in batch.column(0).slice(a, b - a).to_pylist() for _, f in features(t)]
            if found:
                seen += np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket; the driver gets ``BUCKETS`` sums, whatever the input."""
    counts = texts.select(text_col).mapInArrow(_tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, by bucket."""
    s, t = float(source.sum()), float(target.sum())
    return np.array([floor(1000 * log((b + 1.0) * (s + BUCKETS) / ((a + 1.0) * (t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(text: Column, gain: np.ndarray) -> Column:
    """``n_words, n_features, weight`` of a text: the mean gain of its features, rounded down (0 without any)."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]))
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = n = total = 0
            for k, found in features(t):
                words, n, total = words + k, n + len(found), total + int(gain[found % np.uint32(BUCKETS)].sum())
            rows.append((words, n, total // n if n else 0))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    return of(text)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw, rounded down, that hangs on the seed and a key's text alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth_key(rows: DataFrame, keys: list[Column], k: int) -> list[int]:
    """The key of the ``k``-th row in ascending order of some long columns, by radix selection: values of the first columns, as many as it takes
    for exactly ``k`` rows to be at or before them.

    Each pass reads the rows that share the digits found so far and brings one histogram of 2 ** DIGIT rows at most to the driver; bits that all
    those rows have in common need no pass."""
    found: list[int] = []
    within, offset = rows, 1 << 63
    for key in keys:
        low, high, n = within.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        bits = ((low + offset) ^ (high + offset)).bit_length()
        raised = key.bitwiseXOR(F.lit(-offset))  # compares as unsigned
        known = (low + offset) >> bits
        while bits:
            step = min(DIGIT, bits)
            digit = F.shiftrightunsigned(raised, bits - step).bitwiseAND(F.lit((1 << step) - 1))
            same = F.lit(True) if bits == 64 else F.shiftrightunsigned(raised, bits) == F.lit(known)
            counts = {r["d"]: r["count"] for r in within.where(same).groupBy(digit.alias("d")).count().collect()}
            for d in sorted(counts):
                if k <= counts[d]:
                    break
                k -= counts[d]
            known, n, bits = known << step | d, counts[d], bits - step
        found.append(known - offset)
        within = within.where(key == F.lit(known - offset))
        if n == k:
            break
    return found


def up_to(keys: list[Column], last: list[int]) -> Column:
    """Whether the first columns come at or before some values, in lexicographic order."""
    out = keys[len(last) - 1] <= F.lit(last[-1])
    for key, value in reversed(list(zip(keys, last[:-1], strict=False))):
        out = (key < F.lit(value)) | ((key == F.lit(value)) & out)
    return out


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row: rank from 1 for those drawn, null for the others.

    Of the rows with ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest scores are drawn; of equal scores, those with the smaller id, a null
    one last, then the smaller text hash; rows alike in all of that take their ranks in any order. A null id draws as an empty one. A null or empty
    text has no words, weighs 0 and is never drawn. Repeated rows are documents of their own; other columns are ignored. An empty table gives no
    rows, an empty target one that favours what is rare."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(texts), bucket_counts(target.select(F.col(target_text).alias("text"))))
    rows = texts.select("doc_id", F.xxhash64("text").alias("print"), weighed(F.col("text"), gain).alias("w")).select("doc_id", "print", "w.*")
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("number", F.monotonically_increasing_id())
    rows = materialise(rows, "scored")
    keys = [-F.col("score"), F.coalesce("doc_id", F.lit(NO_ID)), F.col("doc_id").isNull().cast("long"), F.col("print"), F.col("number")]
    fit = F.col("n_words") >= least_words
    drawn = rows.where(fit).count() * percent // 100
    shown = ("doc_id", "n_words", "n_features", "weight", "score")
    if not drawn:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    chosen = fit & up_to(keys, kth_key(rows.where(fit), keys, drawn))
    ranked = with_positions(*dealt_in_order(rows.where(chosen), keys, [], "drawn"), [])
    return ranked.select(*shown, (F.col("position") + 1).alias("rank")).unionByName(rows.where(~chosen).select(*shown, F.lit(None).cast("long").alias("rank")))
