"""Near-duplicate documents by MinHash bands and SimHash: one document of each group stays.

Documents are alike if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. At that similarity whole
documents' fingerprints differ in up to 15 of 64 bits, too many for any exact index, so most candidates come from twelve MinHash
bands, each of the three shingles that come first in an order of its own and matched by equality; whole-document SimHashes
within two bits, through BK-tree shards, add theirs. Alike documents share a band with a chance of about
one half each. All documents that meet in one group are compared on all shingles of both texts: first each with the group's
first document, then, in groups where some differ from it, every pair that isn't settled. Left out are only pairs that
cannot be alike, by their sizes or by their distances to the first document (Jaccard distance is a metric), and pairs
that are in one component already. Large groups are cut into blocks, and each pair of blocks is a task's work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, unused, with_keys
from .components import components
from .simhash import fingerprint_links, shingle_hashes, signed, simhash, words_of

SIZE, LEAST, SAMPLES, SAMPLED, RADIUS = 5, 0.8, 12, 3, 2
#: Bytes of a shingle's hash when sets are compared: at 32 bits, unlike texts of a million words come out 0.0001 alike by chance.
WIDTH = 4
#: Bytes of shingle hashes in a block of a group's members; a longer text stands alone.
BLOCK_BYTES = 1 << 20
_ORDERS = np.random.default_rng(9).integers(0, 1 << 64, (SAMPLES, 2), np.uint64) | np.uint64(1)


def sampled_prints(distinct: np.ndarray) -> list[int]:
    """For each order, a fingerprint of the shingles that come first in it."""
    out = []
    for xor, mult in _ORDERS:
        v = (distinct ^ xor) * mult
        v ^= v >> np.uint64(32)
        k = min(SAMPLED, len(v))
        first = np.partition(v, k - 1)[:k] if len(v) > k else v
        out.append(signed(xxhash.xxh64_intdigest(np.sort(first).tobytes())))
    return out


def short_hashes(text: str | None) -> bytes:
    """All distinct shingles of a text as sorted hashes of ``WIDTH`` bytes each."""
    h = np.unique(shingle_hashes(words_of(text), SIZE) & np.uint64((1 << 8 * WIDTH) - 1))
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def wide(hashes: bytes) -> np.ndarray:
    return np.pad(np.frombuffer(hashes, np.uint8).reshape(-1, WIDTH), ((0, 0), (0, 8 - WIDTH))).view("<i8").ravel()


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two such sets; two empty ones are equal."""
    x, y = wide(a), wide(b)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


_SKETCH = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("samples", T.ArrayType(T.LongType()))])


@F.pandas_udf(_SKETCH)
def _sketch(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        words = words_of(t)
        h = shingle_hashes(words, SIZE)
        distinct = np.unique(h)
        rows.append((xxhash.xxh3_128_digest(b" ".join(words)), signed(simhash(h)), sampled_prints(distinct) if len(distinct) else []))
    return pd.DataFrame(rows, columns=["words", "fp", "samples"])


@F.pandas_udf(T.BinaryType())
def _shorts(text: pd.Series) -> pd.Series:
    return pd.Series([short_hashes(t) for t in text])


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def alike_pairs(nodes: np.ndarray, blocks: np.ndarray, apart: np.ndarray, hashes: list[bytes]) -> list[tuple[int, int]]:
    """Pairs that connect all alike members of one block, or of two blocks across them. ``apart``: distances to the first document
    of the group, which connects those that are alike to it."""
    size = np.array([len(h) // WIDTH for h in hashes])
    order = np.lexsort((nodes, size))
    nodes, blocks, apart, size = nodes[order], blocks[order], apart[order], size[order]
    kinds, flat = np.unique(wide(b"".join(hashes[i] for i in order)), return_inverse=True)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(nodes)), size)
    group = np.where(1 - apart >= LEAST, len(nodes), np.arange(len(nodes)))
    two, mark, out = len(np.unique(blocks)) > 1, np.zeros(len(kinds), bool), []
    for x in range(len(nodes)):
        stop = int(np.searchsorted(size, size[x] / LEAST + 1e-6, "right"))
        rest = slice(x + 1, stop)
        todo = (group[rest] != group[x]) & (np.abs(apart[rest] - apart[x]) <= 1 - LEAST + 1e-9)
        if two:
            todo &= blocks[rest] != blocks[x]
        if not todo.any():
            continue
        own = flat[ends[x] - size[x] : ends[x]]
        mark[own] = True
        span = slice(ends[x], ends[stop - 1])
        common = np.bincount(owner[span][mark[flat[span]]] - x - 1, minlength=stop - x - 1)
        mark[own] = False
        for y in (np.flatnonzero(todo & (common / np.maximum(size[x] + size[rest] - common, 1) >= LEAST)) + x + 1).tolist():
            if group[x] != group[y]:
                group[group == group[y]] = group[x]
                out.append((int(nodes[x]), int(nodes[y])))
    return out


_PAIRS = T.StructType([T.StructField(n, T.LongType()) for n in ("u", "v")])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``way, value, i, j, node, block, apart, shorts`` sorted by the first four, which name a cell."""

    def settled() -> list[tuple[int, int]]:
        node, block, apart, hashes = zip(*held, strict=True)
        return alike_pairs(np.array(node, np.int64), np.array(block, np.int64), np.array(apart, np.float64), hashes)

    key, held, found = None, [], []
    for batch in batches:
        for *cell, node, block, apart, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cell != key:
                found += settled() if len(held) > 1 else []
                key, held = cell, []
            held.append((node, block, apart, hashes))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["u", "v"])
        found = []
    if len(held) > 1:
        found = settled()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["u", "v"])


def _compared(stars: DataFrame, shorts: DataFrame) -> DataFrame:
    """Edges ``u``, ``v`` among the members of groups of which some differ from the first document. ``stars``: ``way, value, node,
    centre, likeness``. Groups of the same members are one."""
    open_ = stars.groupBy("way", "value").agg(F.min("centre").alias("centre"), F.count("node").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"), F.min("likeness").alias("least"))
    open_ = open_.where((F.col("n") > 1) & (F.col("least") < LEAST)).groupBy("centre", "n", "members").agg(F.min(F.struct("way", "value")).alias("k")).select("k.*")
    members = stars.join(open_, ["way", "value"], "left_semi").join(shorts.select("node", F.octet_length("shorts").alias("size")), "node")
    so_far = Window.partitionBy("way", "value").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    dealt = members.select("way", "value", "node", (1 - F.col("likeness")).alias("apart"), F.floor(F.sum(F.col("size") + 64).over(so_far) / BLOCK_BYTES).alias("block"))
    dealt = materialise(dealt, "dealt")
    last = dealt.groupBy("way", "value").agg(F.max("block").alias("last"))
    cell = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))).alias("cell")
    cells = dealt.join(last, ["way", "value"]).select("way", "value", "node", "apart", "block", cell).join(shorts, "node")
    cells = cells.select("way", "value", "cell.i", "cell.j", "node", "block", "apart", "shorts")
    return cells.repartition("way", "value", "i", "j").sortWithinPartitions("way", "value", "i", "j").mapInArrow(_cells, _PAIRS)


def _starred(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of each member with the least member of its group: ``keys``, ``node``, ``centre``."""
    least = groups.groupBy(*keys).agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return groups.join(least, keys).where("node <> centre")


def duplicates(base: DataFrame) -> DataFrame:
    """``node`` and ``root``: every document of ``base`` (``doc``, a number of its own; ``text``) that goes, and the document of its group, the one with the
    least number, that stays.

    Equal texts, up to A-Z case and blanks, are one node throughout. Documents without words are copies of each other; one of fewer
    than five words has its whole sequence as its only shingle."""
    sketch = materialise(base.select("doc", _sketch("text").alias("s")).select("doc", "s.*"), "sketch")
    nodes = materialise(sketch.groupBy("words").agg(F.min(F.struct("doc", "fp", "samples")).alias("m")).select("words", F.col("m.doc").alias("node"), "m.fp", "m.samples"), "nodes")
    copies = sketch.select("doc", "words").join(nodes.select("words", "node"), "words").where("doc <> node").select(F.col("doc").alias("u"), F.col("node").alias("v"))
    linked = components(fingerprint_links(nodes.select("fp").distinct(), RADIUS, "fp")).withColumnRenamed("node", "fp")
    whole = nodes.join(linked, "fp", "left").select("node", F.lit(SAMPLES).alias("way"), F.coalesce("root", "fp").alias("value"))
    ways = nodes.select("node", F.posexplode("samples").alias("way", "value")).unionByName(whole)
    stars = materialise(_starred(ways, ["way", "value"]), "stars")
    pairs = stars.select("node", "centre").distinct()
    needed = pairs.select("node").unionByName(pairs.select(F.col("centre").alias("node"))).distinct()
    shorts = materialise(base.select(F.col("doc").alias("node"), "text").join(needed, "node", "left_semi").select("node", _shorts("text").alias("shorts")), "shorts")

    other = shorts.select(F.col("node").alias("centre"), F.col("shorts").alias("other"))
    measured = materialise(pairs.join(shorts, "node").join(other, "centre").select("node", "centre", _likeness("shorts", "other").alias("likeness")), "measured")
    inside = _compared(stars.join(measured, ["node", "centre"]), shorts)
    edges = measured.where(F.col("likeness") >= LEAST).select(F.col("node").alias("u"), F.col("centre").alias("v")).unionByName(inside)
    out = components(edges.unionByName(copies))
    discard(sketch, nodes, stars, shorts, measured)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their own columns, one document of each group of near-duplicates: the one with the least id (null is last) and,
    among rows of one id, the least text hash. Null and empty texts are copies of each other. Of rows with one id and one text, one stays."""
    free = unused(docs.columns)
    key = free("key")
    rows, several = with_keys(docs, id_col, text_col, key)
    if several:
        whole = F.struct(*[F.col(c) for c in docs.columns])
        row = free("row")
        rows = rows.groupBy(key).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias(row)).select(key, f"{row}.*")
        rows = materialise(rows, "rows")
    gone = duplicates(rows.select(F.col(key).alias("doc"), F.col(text_col).alias("text"))).select(F.col("node").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)
