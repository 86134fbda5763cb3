"""Substring dedup by seed and extend: passages of many words that stand anywhere else as well are removed.

Documents meet on winnowed anchors (see :mod:`.repeats`), which are the seeds. Within an anchor each pair of different
segments is extended from the seed to the left and to the right as far as the words agree; where both extensions
together reach the length threshold, the pair has a maximal repeat, and every window inside it is marked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import Kind, Row, Sequence, removed, repeated_windows, unsqueeze

LENGTH, GRAM = 35, 8


def extensions(left: np.ndarray, right: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each row agrees with row ``i`` to the left of the seed and to the right of its start. ``left`` is reversed."""
    reach = []
    for side in (left, right):
        same = (side == side[i]) & (side != 0)
        reach.append(np.where(same.all(axis=1), side.shape[1], same.argmin(axis=1)))
    return reach[0], reach[1]


def resolve(groups: list[list[Row]], window: int) -> list[tuple[int, int, int]]:
    """Runs ``(doc, first, last)`` of window starts that also stand in another segment of the group."""
    out = []
    for group in groups:
        n, number = len(group), {}
        lo, hi, da = (np.array([row[i] for row in group], np.int64) for i in (1, 2, 3))
        run = hi - lo
        left, right = np.zeros((n, window), np.int64), np.zeros((n, window), np.int64)
        for i, row in enumerate(group):
            words = np.array([number.setdefault(w, len(number) + 1) for w in row[4].split()])
            back, ahead = words[: da[i]][::-1], words[da[i] : da[i] + window]
            left[i, : len(back)], right[i, : len(ahead)] = back, ahead
        for i in range(n):
            el, er = extensions(left, right, i)
            el[i] = er[i] = 0
            # windows by the offset of the seed in them: what both segments hold, and both extensions reach
            high = np.minimum(np.minimum(el, da), da[i])
            low = np.maximum(np.maximum(window - er, da - run), da[i] - run[i])
            hit = np.flatnonzero((low <= high) & (el + er >= window))
            for a, b in {(int(low[j]), int(high[j])) for j in hit}:
                out.append((group[i][0], int(lo[i] + da[i] - b), int(lo[i] + da[i] - a)))
    return out


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, unchanged."""
    return text.encode("utf-8", "surrogatepass").split()


def read(text: str) -> Sequence:
    words = words_of(text)
    digest = xxhash.xxh64_intdigest
    codes = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    begins = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)), out=begins[1:])
    return Sequence(codes, b" ".join([*words, b""]), begins)


def kind_of(length: int = LENGTH, gram: int = GRAM, **limits: int) -> Kind:
    return Kind(length, gram, False, False, read, resolve, **limits)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **limits: int) -> DataFrame:
    """``doc_id, n_words, spans, kept`` of every row: spans of words (end exclusive) covered by windows of ``length`` words
    that start anywhere else as well, and the kept words joined by single blanks. Null or short texts keep all words. Every
    row is a document of its own, whatever its id: repeated rows lose all of a text that is long enough. Other columns are ignored."""
    kind = kind_of(length, **limits)

    @F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType())]))
    def cut(squeezed: pd.Series, runs: pd.Series, copy: pd.Series, copies: pd.Series) -> pd.DataFrame:
        rows = []
        for data, r, i, n in zip(squeezed, runs, copy, copies, strict=True):
            words = words_of(unsqueeze(data))
            spans = removed(len(words), i, n, r, kind)
            at, kept = 0, []
            for a, b in spans:
                kept += words[at:a]
                at = b
            rows.append((len(words), [{"start": a, "end": b} for a, b in spans], b" ".join(kept + words[at:]).decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_words", "spans", "kept"])

    found = repeated_windows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), kind)
    return found.select("doc_id", cut("squeezed", "runs", "copy", "copies").alias("x")).select("doc_id", "x.*")


def digest(found: DataFrame) -> DataFrame:
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", size.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
