"""Context-triggered piecewise hashing: document fingerprints that survive local edits.

A rolling hash over seven bytes ends a chunk wherever its low bits are all ones; each chunk gives one base-64
character. A fingerprint ``k:s1:s2`` holds the signatures at block sizes ``2**k`` and ``2**(k+1)``; two
fingerprints are compared, by edit distance, at the block sizes that they have in common.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, sliced

WINDOW, LEAST_K, MOST, FEWEST = 7, 2, 64, 32
#: Ranges of the id for each shuffle partition: several small ones spread more evenly.
RANGES = 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(mult: int, n: int) -> np.ndarray:
    have = _powers.get(mult)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 4096), mult, np.uint64)
        steps[0] = 1
        have = _powers[mult] = np.multiply.accumulate(steps)
    return have


def _scan(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of possible chunks, their level (trailing ones of the rolling hash) and the running polynomial sum."""
    roll = np.zeros(len(buf), np.uint32)
    wide = buf.astype(np.uint32)
    mult = 1
    for j in range(WINDOW):
        roll[j:] += wide[: len(buf) - j] * np.uint32(mult)
        mult = mult * 0x01000193 & 0xFFFFFFFF
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    at = np.flatnonzero((roll & np.uint32((1 << LEAST_K) - 1)) == (1 << LEAST_K) - 1)
    low = ~roll[at]
    low &= -low.astype(np.int32).view(np.uint32)  # lowest zero of the hash
    level = np.where(low == 0, 31, np.log2(np.maximum(low, 1)).astype(np.int32)).astype(np.int8)
    total = np.cumsum(wide.astype(np.uint64) * _power_table(_MULT, len(buf))[: len(buf)] + np.uint64(0), dtype=np.uint64)
    return at + 1, level, total


def _first_k(n: int) -> int:
    return max(LEAST_K, (max(n, 1) - 1).bit_length() - 6)


def _signature(ends: np.ndarray, sums: np.ndarray, start: int, before: int, end: int, last: int) -> bytes:
    """Characters of the chunks that end at ``ends`` (running sums there), and of what is left up to ``end``."""
    if len(ends) >= MOST:
        ends, sums = ends[: MOST - 1], sums[: MOST - 1]
    starts = np.concatenate([[start], ends])
    marks = np.concatenate([np.array([before], np.uint64), sums, np.array([last], np.uint64)])
    if starts[-1] == end:
        starts, marks = starts[:-1], marks[:-1]
    if not len(starts):
        return b""
    h = (marks[1:] - marks[:-1]) * _power_table(_INVERSE, int(starts[-1]) + 1)[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes()


def _level(counts: np.ndarray, n: int) -> int:
    """Base-two logarithm of the block size for a text of ``n`` bytes, from the number of chunk ends of each level: what suits the length,
    or the largest below that has enough chunks."""
    at_least = counts[::-1].cumsum()[::-1]
    k = min(_first_k(n), 30)
    while k > LEAST_K and at_least[k] < FEWEST - 1:
        k -= 1
    return k


def _assemble(ends, levels, sums, start, before, end, last, n) -> str:
    k = _level(np.bincount(levels, minlength=34), n)
    out = []
    for level in (k, k + 1):
        pick = levels >= level
        out.append(_signature(ends[pick], sums[pick], start, before, end, last))
    return f"{k}:{out[0].decode()}:{out[1].decode()}"


def _slices(data: bytes):
    """Ends of possible chunks, their levels and the running sums there, and the sum after it, for each slice of a text."""
    total = 0
    for base in range(0, len(data), SLICE_BYTES):
        head = min(base, WINDOW - 1)
        at, level, run = _scan(np.frombuffer(data, np.uint8)[base - head : base + SLICE_BYTES])
        shift = pow(_MULT, base - head, 1 << 64)
        skip = int(run[head - 1]) if head else 0
        new = at > head
        sums = (run[at[new] - 1] - np.uint64(skip)) * np.uint64(shift) + np.uint64(total)
        total = (total + (int(run[-1]) - skip) * shift) & 0xFFFFFFFFFFFFFFFF
        yield at[new] + (base - head), level[new], sums, total


def _long(data: bytes) -> str:
    """One long text, a slice at a time, to the same fingerprint: a first pass counts chunk ends by level, a second keeps the few
    that the signatures need."""
    n, counts, total = len(data), np.zeros(34, np.int64), 0
    for _, level, _, total in _slices(data):
        counts += np.bincount(level, minlength=34)
    k, out = _level(counts, n), []
    kept: list[list[tuple[int, int]]] = [[], []]
    for ends, level, sums, _ in _slices(data):
        for own, least in zip(kept, (k, k + 1), strict=True):
            pick = np.flatnonzero(level >= least)[: MOST - 1 - len(own)]
            own += zip(ends[pick].tolist(), sums[pick].tolist(), strict=True)
        if all(len(own) == MOST - 1 for own in kept):
            break
    for own in kept:
        starts, marks = [0, *(e for e, _ in own)], [0, *(s for _, s in own), total]
        chars = []
        for i, at in enumerate(starts):
            if at == n:
                break
            # positions of a long text have no table of inverse powers: scale each chunk by its own inverse
            h = (marks[i + 1] - marks[i]) * pow(_INVERSE, at, 1 << 64) & 0xFFFFFFFFFFFFFFFF
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
            chars.append(ALPHABET[h >> 58])
        out.append(bytes(chars).decode())
    return f"{k}:{out[0]}:{out[1]}"


def fingerprints(texts: list[str | None]) -> list[str]:
    """Fingerprint of each text; null counts as empty. Equal texts have equal fingerprints."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[str] = []
    gap = bytes(WINDOW)
    for a, b in sliced([len(r) + WINDOW for r in raw]):
        if b - a == 1 and len(raw[a]) > SLICE_BYTES:
            out.append(_long(raw[a]))
            continue
        buf = np.frombuffer(gap + gap.join(raw[a:b]), np.uint8)
        at, level, run = _scan(buf)
        sums = run[at - 1]
        start = WINDOW
        for r in raw[a:b]:
            end = start + len(r)
            lo, hi = np.searchsorted(at, (start + 1, end + 1))
            out.append(_assemble(at[lo:hi], level[lo:hi], sums[lo:hi], start, run[start - 1], end, run[end - 1], len(r)))
            start = end + WINDOW
    return out


_CODE = np.full(256, 64, np.uint8)
_CODE[ALPHABET] = np.arange(64, dtype=np.uint8)


def edit_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Edit distances of pairs of signatures of up to 64 characters, bit-parallel over the whole batch."""
    n = len(left)
    pad = lambda rows: np.frombuffer(b"".join(r.ljust(MOST, b"\0") for r in rows), np.uint8).reshape(n, MOST)
    a, b = _CODE[pad(left)], _CODE[pad(right)]
    m = np.array([len(x) for x in left], np.int64)
    lens = np.array([len(x) for x in right], np.int64)
    rows, one = np.arange(n), np.uint64(1)
    seen = np.zeros((n, 65), np.uint64)
    for j in range(int(m.max(initial=0))):
        seen[rows, a[:, j]] |= np.where(j < m, one << np.uint64(j), np.uint64(0))
    vp, vn, score = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(n, np.uint64), m.copy()
    top = (np.maximum(m, 1) - 1).astype(np.uint64)
    for i in range(int(lens.max(initial=0))):
        eq = seen[rows, b[:, i]]
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        step = ((hp >> top) & one).astype(np.int64) - ((hn >> top) & one).astype(np.int64)
        score += np.where(i < lens, step, 0)
        hp, hn = (hp << one) | one, hn << one
        vp, vn = hn | ~(d0 | hp), hp & d0
    return np.where(m == 0, lens, score)


def likeness(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: one less the edit distance over the longer length, at the best block size
    that both have; 1 for equal fingerprints, 0 where no block size is shared, NaN where one is null."""
    out = np.zeros(len(left))
    at, a, b = [], [], []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x is None or y is None:
            out[i] = np.nan
        elif x == y:
            out[i] = 1.0
        else:
            (k, *s), (q, *t) = x.split(":"), y.split(":")
            gap = int(q) - int(k)
            pairs = {0: ((0, 0), (1, 1)), 1: ((1, 0),), -1: ((0, 1),)}.get(gap, ())
            for u, v in pairs:
                if s[u] and t[v]:
                    at.append(i), a.append(s[u].encode()), b.append(t[v].encode())
    if at:
        longer = np.maximum([len(x) for x in a], [len(x) for x in b])
        np.maximum.at(out, at, 1 - edit_distances(a, b) / longer)
    return out


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series(fingerprints(text.tolist()))


@F.pandas_udf(T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]))
def _compare(edited: pd.Series, own: pd.Series, following: pd.Series) -> pd.DataFrame:
    new = fingerprints(edited.tolist())
    mine = own.tolist()
    return pd.DataFrame({"fingerprint": new, "near_edited": likeness(mine, new), "near_next": likeness(mine, following.tolist())})


def _longs(values: list[int]) -> Column:
    """A literal array, however long, as one expression that is folded before the query runs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket(value: Column, bounds: list[int]) -> Column:
    """Number of (sorted) bounds at or below the value. Bounds lie in the cells of an even grid; only those in the value's own
    cell are compared. Both sides count cells in the same double arithmetic, which never reverses order."""
    if not bounds:
        return F.lit(0)
    grid, low = len(bounds), float(bounds[0])
    width = max((float(bounds[-1]) - low) / grid, 1.0)
    cells = [min(max(int((float(b) - low) // width), 0), grid - 1) for b in bounds]
    starts = [0] * (grid + 1)
    for c in cells:
        starts[c + 1] += 1
    for c in range(grid):
        starts[c + 1] += starts[c]
    share = F.floor((value.cast("double") - F.lit(low)) / F.lit(width))
    cell = F.greatest(F.lit(0), F.least(F.lit(grid - 1), share)).cast("int")
    first = F.get(_longs(starts), cell).cast("int")
    n = F.get(_longs(starts), cell + 1).cast("int") - first
    return (first + F.size(F.filter(F.slice(_longs(bounds), first + 1, n), lambda b: b <= value))).cast("int")


def _parted(rows: DataFrame, parts: int, several: bool) -> tuple[Column, Column]:
    """Part of a row with ``id`` and ``h``: ranges of the id that hold about equally many rows; an id (or null) with more rows than that
    has ranges of its own, by ``h``."""
    hot = {}
    if several:
        limit = max(1, rows.count() // parts)
        hot = {r["id"]: -(-r["count"] // limit) for r in rows.groupBy("id").count().where(F.col("count") > limit).collect()}  # at most ``parts`` ids
    bounds = set(map(int, rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else set()
    bounds |= {i + d for i in hot if i is not None for d in (0, 1) if i + d < 1 << 63}
    split = F.lit(hot.pop(None, 1))
    if hot:
        own = F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])
        split = F.when(F.col("id").isNull(), split).otherwise(F.coalesce(F.element_at(own, F.col("id")), F.lit(1)))
    sub = F.floor((F.col("h").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * split).cast("int")
    return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(bucket(F.col("id"), sorted(bounds))), sub


def followed(docs: DataFrame, id_col: str, carry: list[str], parts: int) -> DataFrame:
    """Each row with the ``carry`` columns of the next one in descending order of ``id_col``, null last (as ``next_<name>``); the
    last is followed by the first. Rows are dealt to ranges of that order, and each range also gets the first row of the one
    after it, so that no task orders the whole table: only the ranges reach the driver. Rows of one id are ordered by a hash of the
    ``carry`` columns; those alike in these too are followed by each other."""
    rows = docs.withColumn("id", F.col(id_col).cast("long"))
    several = not rows.groupBy("id").count().where("count > 1").isEmpty()
    rows = rows.withColumn("h", F.xxhash64(*carry) if several else F.lit(0).cast("long"))
    if several:
        rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    part, sub = _parted(rows.select("id", "h"), parts, several)
    rows = rows.withColumns({"part": part, "sub": sub})
    place = F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("back"), "h")  # the order as a struct: ``back`` falls as the id grows
    heads = sorted((tuple(r["top"]), r["part"], r["sub"]) for r in rows.groupBy("part", "sub").agg(F.min(place).alias("top")).collect())
    firsts = [(None if top[1] is None else ~top[1], top[2], part, sub) for (top, _, _), (_, part, sub) in zip(heads[1:] + heads[:1], heads, strict=True)]
    wanted = docs.sparkSession.createDataFrame(firsts, "id long, h long, part int, sub int").withColumnsRenamed({"id": "id_", "h": "h_"})
    ghosts = rows.drop("part", "sub").join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")))
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts.drop("id_", "h_").withColumn("ghost", F.lit(True)))
    w = Window.partitionBy("part", "sub").orderBy("ghost", F.col("id").desc_nulls_last(), "h", *carry)
    out = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where(~F.col("ghost"))
    if several:
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        out = out.withColumns({f"next_{c}": F.when(F.col("copy") < F.col("copies"), F.col(c)).otherwise(F.col(f"next_{c}")) for c in carry}).drop("copy", "copies")
    return out.drop("ghost", "part", "sub", "id", "h")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of every text. Null text: fingerprint of the empty text. Rows are kept as they are, repeated ones and
    null ids too; nothing is compared, so there are no ties. An empty table gives an empty result; other columns are ignored."""
    return docs.select(id_col, fingerprint(F.col(text_col)).alias("fingerprint"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last ``1/share`` is replaced by the start of the next document.

    Null text counts as empty; a single document follows itself; an empty table gives an empty result; null ids come last; rows of one
    id are ordered by a hash of the text, and repeated rows follow each other. Columns besides id and text are ignored."""
    parts = max(1, RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("fingerprint", fingerprint("text"))
    rows = followed(base, "doc_id", ["text", "fingerprint"], parts)
    n = F.length("text")
    cut = F.floor(n / F.lit(share)).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("got", _compare("edited", "fingerprint", "next_fingerprint"))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        F.col("got.fingerprint").alias("edited_fingerprint"), F.col("got.near_edited").alias("near_edited"), F.col("got.near_next").alias("near_next"),
    )
