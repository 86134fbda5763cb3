"""Exact repeats of fixed-length windows across all documents, by anchors that equal windows share.

Every window of ``window`` symbols holds ``window - gram + 1`` grams; the one with the least hash is its anchor. Equal
windows have equal anchors at equal offsets, so all occurrences of a window meet under its anchor. Consecutive windows
with one anchor form a segment, and about two in ``window - gram + 2`` positions begin one. The steps:

1. Each task cuts its documents into segments and collapses those that are equal, byte for byte, so a passage that a
   third of all documents share crosses the network once from each task.
2. Segments meet by anchor. Those that are alone are done with; all others fetch their text, by document.
3. A resolver compares the texts under an anchor by the operator's own method.
4. Anchors with very many segments (a common phrase in ever new contexts) are not met at all if a count by task shows
   them, or give up meeting; their windows are dealt singly instead, keyed by a hash of the window, and resolved alike.
5. The repeated windows of each document are joined to its text.

Hashes only decide what is compared with what: every repeat is found on the symbols themselves. Documents are shipped
compressed. Every row is a document of its own. Where ids repeat or several are null, documents are keyed by numbers in the order
of id (null last) and text hash, and rows of one id and one text are kept as a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, with_keys

#: Symbols hashed at a time (positions must fit into 20 bits), segments and bytes of text collapsed at a time, segments of an
#: anchor beyond which it is split into windows, rows of one anchor held at a time, bytes resolved at a time, and bytes of a document
#: that one group of stretches spans.
SLICE, LOCAL_ROWS, LOCAL_BYTES, HOT, HELD, RESOLVED, REACH = 1 << 19, 500_000, 8 << 20, 200, 400_000, 1 << 19, 10
#: Longest window, in symbols: a start, an offset and a run have 63 bits together, and a text has less than 2 ** 31 symbols.
LONGEST = (1 << 16) - 1
#: An anchor is heavy if it has more segments than this share of what a shuffle partition holds.
HEAVY = 0.25
_MULT = 0xD1342543DE82EF95
_INVERSE = pow(_MULT, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Sequence:
    """A text as ``codes``, 64-bit hashes of its symbols, and ``data``, the bytes in which symbol ``i`` begins at ``begins[i]`` (None: at
    ``i``)."""

    codes: np.ndarray
    data: bytes
    begins: np.ndarray | None = None

    def content(self, first: int, end: int) -> bytes:
        """The symbols from ``first`` up to ``end``."""
        return self.data[first:end] if self.begins is None else self.data[self.begins[first] : self.begins[end]]


#: A stretch of window starts ``lo`` to ``hi`` of a document, the offset of the anchor in the first of them, and its symbols.
Row = tuple[int, int, int, int, bytes]


@dataclass(frozen=True)
class Kind:
    """What repeats are: ``read(text)`` gives the sequence; ``resolve(groups, window)`` the runs ``(doc, first, last)`` of repeated window
    starts in groups of rows of different symbols each."""

    window: int
    gram: int
    earlier_only: bool  # keep the first occurrence of a window, or none
    stretched: bool  # anchors of the same documents form one group, and their segments long stretches
    read: Callable[[str], Sequence]
    resolve: Callable[[list[list[Row]], int], list[tuple[int, int, int]]]
    hot: int = HOT
    held: int = HELD
    local_rows: int = LOCAL_ROWS

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.window <= LONGEST:
            raise ValueError(f"a window has at least its gram's symbols and at most {LONGEST:,}")

    @property
    def bits(self) -> int:
        """Bits that hold an offset within a window: places are a start, the offset of the anchor in it, and the length of the run."""
        return self.window.bit_length()

    def placed(self, start: np.ndarray, offset: np.ndarray, run: np.ndarray) -> np.ndarray:
        return (start << 2 * self.bits) | (offset << self.bits) | run

    def place_of(self, place: int) -> tuple[int, int, int]:
        low = (1 << self.bits) - 1
        return place >> 2 * self.bits, place >> self.bits & low, place & low


def _powers(mult: int, n: int) -> np.ndarray:
    have = _tables.get(mult)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 4096), mult, np.uint64)
        steps[0] = 1
        have = _tables[mult] = np.multiply.accumulate(steps)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums, one more than there are codes."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers(_MULT, len(codes))[: len(codes)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the codes of each span, wherever it stands."""
    return (sums[end] - sums[start]) * _powers(_INVERSE, len(sums))[start]


def segments(codes: np.ndarray, bounds: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, first and last window start and anchor position of all segments of some sequences,
    which stand one after the other in ``codes`` between ``bounds``."""
    n, w = len(codes), kind.window - kind.gram + 1
    empty = np.zeros(0, np.int64)
    if n < kind.window:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    sums = prefix(codes)
    grams = n - kind.gram + 1
    h = (sums[kind.gram :] - sums[:-kind.gram]) * _powers(_INVERSE, n)[:grams]
    h = mixed(h)
    v = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(grams, dtype=np.uint64)
    rows = -(-grams // w)
    wide = np.full(rows * w, 0xFFFFFFFFFFFFFFFF, np.uint64)
    wide[:grams] = v
    wide = wide.reshape(rows, w)
    front = np.minimum.accumulate(wide, axis=1).ravel()
    back = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - kind.window + 1
    anchor = (np.minimum(back[:starts], front[w - 1 : w - 1 + starts]) & np.uint64(0xFFFFF)).astype(np.int64)
    valid = np.zeros(starts + 1, bool)
    begins, ends = bounds[:-1], bounds[1:]
    long = ends - begins >= kind.window
    step = np.zeros(starts + 1, np.int32)
    np.add.at(step, begins[long], 1)
    np.add.at(step, ends[long] - kind.window + 1, -1)
    valid = np.cumsum(step)[:starts] > 0
    fresh = valid.copy()
    first_of = np.zeros(starts, bool)
    first_of[begins[long]] = True
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | first_of[1:]
    lo = np.flatnonzero(fresh)
    stop = valid & np.append(~valid[1:] | fresh[1:], True)
    hi = np.flatnonzero(stop)
    a = anchor[lo]
    content = mixed(span_hash(sums, lo, hi + kind.window) ^ ((a - lo) << 8 | (hi - lo)).astype(np.uint64))
    return h[a], content, lo, hi, a


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


SEGMENT, RUN, COUNT = 0, 1, 2
#: ``place``: first window, offset of the anchor and number of further windows of a segment (7 bits each), first window of a run, or
#: segments of an anchor in a task. ``g``: anchor, or last window of a run.
_CUT = T.StructType([T.StructField("kind", T.ByteType())] + [T.StructField(n, T.LongType()) for n in ("g", "doc", "place")])


def _cut_rows(kind_: int, g, doc, place) -> Iterator[pa.RecordBatch]:
    n = len(place)
    cols = [np.broadcast_to(x, n) for x in (g, doc, place)]
    for i in range(0, n, 50_000):
        part = [pa.array(np.ascontiguousarray(x[i : i + 50_000], np.int64)) for x in cols]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind_, np.int8)), *part], names=_CUT.names)


def _collapse(rows: list[tuple], texts: dict[int, Sequence], kind: Kind, share: float) -> Iterator[pa.RecordBatch]:
    """One row of each segment of different symbols, the first; others are runs."""
    g, c, doc, lo, da, run, text = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((lo, doc, c, g))
    g, c, doc, lo, da, run, text = (x[order] for x in (g, c, doc, lo, da, run, text))
    first = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
    leader = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    other = np.flatnonzero(~first)
    if len(other):
        end = lo + run + kind.window
        whose = lambda i: texts[text[i]].content(lo[i], end[i])
        same = np.fromiter((whose(i) == whose(j) for i, j in zip(other, leader[other], strict=True)), bool, len(other))
        first[other[~same]] = True
        gone = other[same] if kind.earlier_only else np.union1d(other[same], leader[other[same]])
        yield from _cut_rows(RUN, lo[gone] + run[gone], doc[gone], lo[gone])
    g = _signed(g[first])
    yield from _cut_rows(SEGMENT, g, doc[first], kind.placed(lo[first], da[first], run[first]))
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    counts = np.diff(np.append(starts, len(g)))
    heavy = counts > max(len(g) * share / 2, min(kind.hot, 16))
    yield from _cut_rows(COUNT, g[starts[heavy]], 0, counts[heavy])


def _cut(kind: Kind, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, count, texts, size = [], 0, {}, 0
        pieces, waiting, number = [], 0, 0

        def hashed() -> int:
            codes = np.concatenate([p for *_, p in pieces])
            bounds = np.cumsum([0] + [len(p) for *_, p in pieces])
            g, c, lo, hi, a = segments(codes, bounds, kind)
            at = np.searchsorted(bounds, lo, side="right") - 1
            doc, text, begin = (np.array(x, np.int64)[at] for x in list(zip(*pieces, strict=True))[:3])
            rows.append((g, c, doc, lo + begin - bounds[at], a - lo, hi - lo, text))
            return len(g)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seq = kind.read(text or "")
                if len(seq.codes) < kind.window:
                    continue
                number += 1
                texts[number] = seq
                size += len(seq.data)
                for off in range(0, len(seq.codes) - kind.window + 1, SLICE - kind.window + 1):
                    part = seq.codes[off : off + SLICE]
                    if pieces and waiting + len(part) > SLICE:
                        count += hashed()
                        pieces, waiting = [], 0
                        if count >= kind.local_rows or size >= LOCAL_BYTES:
                            yield from _collapse(rows, texts, kind, share)
                            rows, count, texts, size = [], 0, {number: seq}, len(seq.data)
                    pieces.append((doc, number, off, part))
                    waiting += len(part)
                texts[number] = Sequence(seq.codes[:0], seq.data, seq.begins)
        if pieces:
            count += hashed()
        if count:
            yield from _collapse(rows, texts, kind, share)

    return run


_MET = T.StructType([T.StructField(n, T.LongType()) for n in ("doc", "g", "place")] + [T.StructField("crowded", T.BooleanType())])


def _meet(kind: Kind):
    def settle(g, doc, place, hot: bool) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        sizes = np.diff(np.append(starts, len(g)))
        group = np.repeat(np.arange(len(starts)), sizes)
        pick = (sizes > 1)[group] | hot
        if not pick.any():
            return
        crowded = (sizes > kind.hot)[group] | hot
        if kind.stretched:  # rows are sorted: the first of a group occurs first
            docs = np.add.reduceat(mixed(doc.view(np.uint64) + np.uint64(1)), starts)
            again = np.append(False, (g[1:] == g[:-1]) & (doc[1:] == doc[:-1]))
            joint = _signed(mixed(docs ^ mixed(place[starts].view(np.uint64) >> np.uint64(2 * kind.bits + REACH))))
            # the lowest bit: whether an anchor stands twice in one document
            g = np.where(crowded, g, (joint << 1 | np.logical_or.reduceat(again, starts))[group])
        cols = [pa.array(np.ascontiguousarray(x[pick])) for x in (doc, g, place)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(crowded[pick])], names=_MET.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        hot = None  # an anchor of which some rows have gone on
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(batch.column(i).to_numpy() for i in range(3))
            held = cols if held is None else tuple(map(np.concatenate, zip(held, cols, strict=True)))
            g = held[0]
            if hot is not None:
                head = int(np.argmax(g != hot)) if (g != hot).any() else len(g)
                if head:
                    yield from settle(*[x[:head] for x in held], True)
                    held = tuple(x[head:] for x in held)
                    g = held[0]
                if not len(g):
                    held = None
                    continue
                hot = None
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if cut:
                yield from settle(*[x[:cut] for x in held], False)
                held = tuple(x[cut:] for x in held)
            if len(held[0]) > kind.held:
                hot = int(held[0][0])
                yield from settle(*held, True)
                held = None
        if held is not None:
            yield from settle(*held, False)

    return run


@F.pandas_udf(T.BinaryType())
def squeeze(text: pd.Series) -> pd.Series:
    press = zstandard.ZstdCompressor(level=3)
    return pd.Series([press.compress((t or "").encode("utf-8", "surrogatepass")) for t in text])


def unsqueeze(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


_TEXTS = T.StructType([T.StructField(n, T.LongType()) for n in ("g", "sub", "doc", "lo", "hi", "offset")] + [T.StructField("content", T.BinaryType())])


def _stretches(wants: list, kind: Kind) -> Iterator[tuple[int, int, int, int]]:
    """``g, lo, hi, offset`` of the segments that a document wants compared; of one group, those that follow each other are one."""
    last = None
    for g, place in sorted((w["g"], w["place"]) for w in wants):
        lo, offset, run = kind.place_of(place)
        here = [g, lo, lo + run, offset]
        if last and kind.stretched and last[0] == g and lo <= last[2] + 1:
            last[2] = here[2]
            continue
        if last:
            yield tuple(last)
        last = here
    if last:
        yield tuple(last)


def _fetch(kind: Kind):
    def row_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols[:6]], pa.array(cols[6], pa.binary())], names=_TEXTS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, bytes], tuple[int, int, int, bool]] = {}  # of single windows: where each first stands, and whether that is known
        rows, size = [], 0

        def singles() -> list[tuple]:
            digest = xxhash.xxh3_64_intdigest
            return [(g, digest(content) >> 1 | 1, doc, lo, lo, da, content) for (g, content), (doc, lo, da, _) in first.items()]

        for batch in batches:
            for doc, data, wants in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seq = kind.read(unsqueeze(data))
                for g, lo, hi, da in _stretches([w for w in wants if not w["crowded"]], kind):
                    content = seq.content(lo, hi + kind.window)
                    rows.append((g, 0, doc, lo, hi, da, content))
                    size += len(content)
                for w in wants:
                    if not w["crowded"]:
                        continue
                    begin, offset, run_ = kind.place_of(w["place"])
                    for i in range(run_ + 1):
                        lo = begin + i
                        content, here = seq.content(lo, lo + kind.window), (doc, lo)
                        had = first.setdefault((w["g"], content), (doc, lo, offset - i, False))
                        if had[:2] == here:
                            continue
                        low, high = sorted((had[:2], here))
                        first[w["g"], content] = (*low, offset - i, True)
                        rows += [(0, 0, d, x, x, -1, None) for d, x in ((high,) if kind.earlier_only else {high, low} if not had[3] else {here})]
                if len(first) > kind.local_rows // 6:
                    rows, size, first = rows + singles(), size + len(first) * kind.window, {}
                if len(rows) > 20_000 or size > 1 << 22:
                    for i in range(0, len(rows), 20_000):
                        yield row_batch(rows[i : i + 20_000])
                    rows, size = [], 0
        rows += singles()
        for i in range(0, len(rows), 20_000):
            yield row_batch(rows[i : i + 20_000])

    return run


_RUNS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc", "lo", "hi")])


def _alike(group: list[Row], kind: Kind, found: list) -> list[Row]:
    """The first row of each content; the others repeat it in whole."""
    first: dict[bytes, list] = {}
    for row in group:
        had = first.setdefault(row[4], [row, True])
        if had[0] is not row:
            found.append(row[:3])
            if had[1] and not kind.earlier_only:
                found.append(had[0][:3])
            had[1] = False
    return [row for row, _ in first.values()]


def _resolved(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = (0, 0), []  # the group that is read
        worth = lambda: len(group) > 1 or group and kind.stretched and not key[1] and key[0] & 1  # noqa: E731  a stretch may repeat itself
        ready, size, found = [], 0, []
        for batch in batches:
            for g, sub, doc, lo, hi, da, content in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if content is None:
                    found.append((doc, lo, hi))
                    continue
                if (g, sub) != key:
                    if worth():
                        group = _alike(group, kind, found)
                        if worth():
                            ready.append(group)
                            size += sum(len(row[4]) for row in group)
                    if size > RESOLVED:
                        found += kind.resolve(ready, kind.window)
                        ready, size = [], 0
                    key, group = (g, sub), []
                elif sub and len(group) >= 2 * kind.hot:  # the same window from very many tasks: a bounded part at a time
                    group = _alike(group, kind, found)
                group.append((doc, lo, hi, da, content))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=_RUNS.names)
                found = []
        if worth():
            group = _alike(group, kind, found)
            ready += [group] if worth() else []
        found += kind.resolve(ready, kind.window) if ready else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=_RUNS.names)

    return run


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``doc, doc_id, text, copies``: ``doc`` orders documents by id, null last, and stands for one text; ``copies``: rows of this id and
    text. And whether any text may have several copies."""
    rows, several = with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text", "doc")
    if not several:
        return rows.withColumn("copies", F.lit(1)), False
    one = rows.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).cast("int").alias("copies"))
    return materialise(one, "keyed"), True


def _heavy(cut: DataFrame, share: float) -> DataFrame:
    """Anchors with more than a ``share`` of all segments, as ``g``. Each task counts those with half that share of its own, so hardly any
    is missed; by the sum of their counts there can be at most twice the inverse of the share, a few for each shuffle partition."""
    total = cut.where(F.col("kind") == SEGMENT).count()
    counts = cut.where(F.col("kind") == COUNT).groupBy("g").agg(F.sum("place").alias("n"))
    return counts.where(F.col("n") > total * share / 2).select("g")


def repeated_windows(docs: DataFrame, kind: Kind) -> DataFrame:
    """``doc_id, copy, copies, squeezed, runs``: every row (``doc_id``, ``text``) with its repeated windows as an array of first and last window
    start. A null id is ordered after all others. Of several rows of one id and one text, ``copy`` counts from 1."""
    share = HEAVY / int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed, several = _keyed(docs)
    cut = materialise(keyed.select("doc", "text").mapInArrow(_cut(kind, share), _CUT), "cut")
    segments_, heavy = cut.where(F.col("kind") == SEGMENT).drop("kind"), materialise(_heavy(cut, share), "heavy")
    plain = segments_.join(F.broadcast(heavy), "g", "left_anti").repartition("g").sortWithinPartitions("g", "doc", "place")
    met = plain.select("g", "doc", "place").mapInArrow(_meet(kind), _MET)
    crowds = segments_.join(F.broadcast(heavy), "g", "left_semi").withColumn("crowded", F.lit(True))
    own = cut.where(F.col("kind") == RUN).withColumn("crowded", F.lit(None).cast("boolean"))
    met = materialise(met.unionByName(crowds.select(*_MET.names)).unionByName(own.select(*_MET.names)), "met")
    discard(cut, heavy)
    wants = met.where("crowded is not null").groupBy("doc").agg(F.collect_list(F.struct("g", "place", "crowded")).alias("wants"))
    texts = keyed.select("doc", "doc_id", "copies", squeeze("text").alias("squeezed"))
    fetched = texts.join(wants, "doc").select("doc", "squeezed", "wants").mapInArrow(_fetch(kind), _TEXTS)
    spread = F.when(F.col("content").isNull(), F.xxhash64("doc")).otherwise(F.col("g"))
    found = fetched.repartition(spread, F.col("sub")).sortWithinPartitions("g", "sub", "doc", "lo").mapInArrow(_resolved(kind), _RUNS)
    runs = met.where("crowded is null").select("doc", F.col("place").alias("lo"), F.col("g").alias("hi")).unionByName(found)
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    out = texts.join(runs, "doc", "left")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))) if several else F.lit(1)
    return out.withColumn("copy", copy).select("doc_id", "copy", "copies", "squeezed", "runs")


def covered(runs, window: int) -> list[tuple[int, int]]:
    """Maximal spans of symbols that the windows of some runs cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + window)
        else:
            out.append([lo, hi + window])
    return [tuple(x) for x in out]


def removed(n: int, copy: int, copies: int, runs, kind: Kind) -> list[tuple[int, int]]:
    """Spans that go from a text of ``n`` symbols. Rows of one id and text are copies of each other, in whole."""
    again = copy > 1 if kind.earlier_only else copies > 1
    if again and n >= kind.window:
        return [(0, n)]
    return covered(runs if runs is not None else (), kind.window)
