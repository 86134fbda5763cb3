"""Suffix-array dedup: bytes that a long match repeats from earlier on are removed; the first copy stays.

Passages that share anchors (see :mod:`.repeats`) are put one after the other in order of occurrence. Their suffixes are
sorted by prefix doubling up to the match length; in suffix order, the previous and the next smaller position of a suffix
give its best earlier matches, and the longer of both is its longest previous factor. Where that reaches the match
length, the bytes go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import Kind, Row, Sequence, removed, repeated_windows, unsqueeze

#: Sorting costs little more for each further passage, so anchors stay whole for longer than by default.
LENGTH, GRAM, HOT = 100, 30, 2000
_CODES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1 on, in the order of the keys."""
    return np.unique(key, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)


def suffix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Pairs of a prefix length and the ranks of all positions by so many bytes, by prefix doubling: 1, 2, 4 and so on, the last
    for ``length`` itself. Up to eight bytes a rank is the number that they spell. Beyond the end stand zeros."""
    rank, have, out = data.astype(np.uint64), 1, []
    while True:
        out.append((have, rank))
        if have >= length:
            return out
        step = min(have, length - have)
        spelled = have < 8 and step == have
        if have <= 8 and not spelled:
            rank = _dense(rank)
        later = np.zeros_like(rank)
        later[:-step] = rank[step:]
        rank = rank << np.uint64(8 * have) | later if spelled else _dense(rank * (rank.max() + np.uint64(1)) + later)
        have += step


def common_prefix(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of positions, at most that of the last ranks."""
    most = ranks[-1][0]
    n = np.where(ranks[-1][1][a] == ranks[-1][1][b], most, 0)
    open_ = np.flatnonzero(n < most)
    a, b, got = a[open_], b[open_], np.zeros(len(open_), np.int64)
    end = len(ranks[0][1]) - 1
    for length, rank in ranks[-2::-1]:
        x, y = np.minimum(a + got, end), np.minimum(b + got, end)
        got += np.where((rank[x] == rank[y]) & (got + length <= most), length, 0)
    n[open_] = np.minimum(got, most)
    return n


def previous_smaller(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each element, the least of ``common`` (between neighbours; the first is 0) on the way back to the last smaller value; 0 where
    there is none. Elements that are not smaller are passed over together with all that they passed over themselves."""
    back, low = np.arange(len(value)) - 1, common.copy()
    todo = np.flatnonzero((low > 0) & (value[back] > value))
    while len(todo):
        over = back[todo]
        low[todo] = np.minimum(low[todo], low[over])
        back[todo] = back[over]
        todo = todo[low[todo] > 0]
        todo = todo[value[back[todo]] > value[todo]]
    return low


def longest_previous(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """The longest-previous-factor array, cut at ``length``: how long a prefix of the suffix at each of the positions ``at`` (in order of
    occurrence) also begins at an earlier one of the same group."""
    ranks = suffix_ranks(data, length)
    own = ranks[-1][1][at]
    order = np.argsort(group.astype(np.uint64) * (own.max() + np.uint64(1)) + own, kind="stable")  # suffix order
    here, where = at[order], group[order]
    common = np.zeros(len(at), np.int64)
    common[1:] = np.where(where[1:] == where[:-1], common_prefix(ranks, here[:-1], here[1:]), 0)
    before = previous_smaller(order, common)
    after = previous_smaller(order[::-1], np.append(0, common[:0:-1]))[::-1]
    out = np.empty(len(at), np.int64)
    out[order] = np.maximum(before, after)
    return out


def resolve(groups: list[list[Row]], window: int) -> list[tuple[int, int, int]]:
    """Runs ``(doc, first, last)`` of window starts whose longest previous factor within their group reaches the window."""
    rows = sorted(((k, *row) for k, group in enumerate(groups) for row in group), key=lambda r: r[:3])
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    starts = np.cumsum([0] + [len(r[5]) for r in rows[:-1]])
    lo = np.array([r[2] for r in rows], np.int64)
    runs = np.array([r[3] for r in rows], np.int64) - lo + 1
    owner = np.repeat(np.arange(len(rows)), runs)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    hit = np.flatnonzero(longest_previous(data, starts[owner] + shift, np.array([r[0] for r in rows])[owner], window) >= window)
    return runs_of(np.array([r[1] for r in rows], np.int64)[owner[hit]], lo[owner[hit]] + shift[hit])


def runs_of(doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(doc):
        return []
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))
    a, b = np.append(0, cut + 1), np.append(cut, len(doc) - 1)
    return list(zip(doc[a].tolist(), start[a].tolist(), start[b].tolist(), strict=True))


def read(text: str) -> Sequence:
    raw = text.encode("utf-8", "surrogatepass")
    return Sequence(_CODES[np.frombuffer(raw, np.uint8)], raw)


def kind_of(length: int = LENGTH, gram: int = GRAM, **limits: int) -> Kind:
    return Kind(length, gram, True, True, read, resolve, **{"hot": HOT, **limits})


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **limits: int) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row: the spans of bytes (end exclusive) that a match of ``length`` bytes
    repeats from a smaller id or from earlier in the same text, and the other bytes. Null or short texts keep all. Of rows
    with one id, or without an id (which come last), those with the lesser text hash come first; of rows alike in both, any
    one comes first. Other columns are ignored."""
    kind = kind_of(length, **limits)

    @F.pandas_udf(T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())]))
    def cut(squeezed: pd.Series, runs: pd.Series, copy: pd.Series, copies: pd.Series) -> pd.DataFrame:
        rows = []
        for data, r, i, n in zip(squeezed, runs, copy, copies, strict=True):
            raw = unsqueeze(data).encode("utf-8", "surrogatepass")
            spans = removed(len(raw), i, n, r, kind)
            at, kept = 0, []
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            rows.append((len(raw), [{"start": a, "end": b} for a, b in spans], b"".join([*kept, raw[at:]])))
        return pd.DataFrame(rows, columns=["n_bytes", "spans", "kept"])

    found = repeated_windows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), kind)
    return found.select("doc_id", cut("squeezed", "runs", "copy", "copies").alias("x")).select("doc_id", "x.*")


def digest(found: DataFrame) -> DataFrame:
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
