"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius through BK-trees.

Of ``radius + 1`` blocks of bits, two fingerprints within the radius have at least one in common. Each distinct fingerprint is
sent once for each block to the shard of those that share it. A shard builds a BK-tree, children keyed by their distance to the
parent, and follows only edges within the radius. It reports a spanning forest of its links, and a distributed
connected-components step joins the shards. Fingerprints of a shard with more than ``SHARD`` of them are sent on to all ways of
leaving ``radius`` of eight blocks of eight bits out; what meets there shares all other bits, so that no tree holds more than
``2 ** (8 * radius)`` fingerprints whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .components import components

SEED, BLOCKS, WIDTH = 42, 8, 8
#: Fingerprints of one BK-tree, beyond which they are dealt more finely.
SHARD = 1 << 14
_CHUNK = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """Words of the text as UTF-8, A-Z lower-cased; bytes.split() cuts at the six blanks of ``[\\x20\\x09-\\x0D]``."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[i:] for i in range(size)), strict=False)
    return np.fromiter((digest(join(r), SEED) for r in runs), np.uint64, len(words) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint: bit set if it is set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[a : a + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_column(text: Column, size: int) -> Column:
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(simhash(shingle_hashes(words_of(t), size))) for t in texts], dtype="int64")

    return of(text)


class BKTree:
    """A BK-tree of 64-bit fingerprints; ``near`` follows only children whose key lies within the radius of the distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def near(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if children:
                todo += [c for k, c in children.items() if -radius <= k - d <= radius]
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        at, children = self.root
        while d := (at ^ value).bit_count():
            if d not in children:
                children[d] = (value, {})
                return
            at, children = children[d]


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a shard's fingerprints."""
    tree, parent, out = BKTree(), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in values:
        parent[v] = v
        for near in tree.near(v, radius):
            a, b = root(v), root(near)
            if a != b:
                parent[a] = b
                out.append((v, near))
        tree.add(v)
    return out


def _shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard: whole shards are linked as they pass; the last of a batch waits for the next batch."""
        key, held = None, []

        def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"u": pa.array([signed(a) for a, _ in links], pa.int64()), "v": pa.array([signed(b) for _, b in links], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            way, shared, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            value = value.astype(np.int64).view(np.uint64)
            new = np.flatnonzero((way[1:] != way[:-1]) | (shared[1:] != shared[:-1])) + 1
            starts, links = [0, *new.tolist()], []
            ends = [*starts[1:], len(way)]
            for a, b in zip(starts, ends, strict=True):
                if a and b < len(way) and b - a == 1:
                    continue
                this = (int(way[a]), int(shared[a]))
                if this == key:
                    held += value[a:b].tolist()
                else:
                    if len(held) > 1:
                        links += shard_links(held, radius)
                    key, held = this, value[a:b].tolist()
            yield emit(links)
        if len(held) > 1:
            yield emit(shard_links(held, radius))

    return run


def block_masks(radius: int) -> list[int]:
    """Masks of ``radius + 1`` blocks that together are all 64 bits."""
    ends = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [signed((1 << b) - (1 << a)) for a, b in zip(ends, ends[1:], strict=False)]


def fine_masks(radius: int) -> list[int]:
    """Masks of all but ``radius`` of the eight blocks of eight bits, in every way."""
    block = ((1 << WIDTH) - 1).__lshift__
    return [signed(((1 << 64) - 1) ^ sum(block(WIDTH * b) for b in out)) for out in combinations(range(BLOCKS), radius)]


def _sent(prints: DataFrame, masks: list[int], first_way: Column | int = 0, *keep: str) -> DataFrame:
    """Rows ``way, shared, fp``: each fingerprint once for each mask, with the bits that the mask leaves."""
    ways = F.array(*[F.struct((F.lit(i) + first_way).cast("int").alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(masks)])
    return prints.select("fp", *keep, F.explode(ways).alias("s")).select("s.way", "s.shared", "fp", *keep)


def fingerprint_links(prints: DataFrame, radius: int = 2, col: str = "fingerprint") -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct fingerprints within ``radius`` bits of each other (a spanning forest of
    each shard, not every pair). Nulls are left out."""
    if not 0 < radius < 4:
        raise ValueError("radius must be 1, 2 or 3")
    one = prints.select(F.col(col).alias("fp")).where("fp is not null").distinct()
    coarse, fine = block_masks(radius), fine_masks(radius)
    sent = _sent(one, coarse)
    large = sent.groupBy("way", "shared").count().where(F.col("count") > SHARD).drop("count")
    again = sent.join(large, ["way", "shared"], "left_semi").select("fp", F.col("way").alias("block"), F.col("shared").alias("held"))
    again = _sent(again, fine, (F.col("block") + 1) * len(fine), "held")
    again = again.select("way", F.col("shared").bitwiseOR(F.col("held")).alias("shared"), "fp")
    shards = sent.join(large, ["way", "shared"], "left_anti").select("way", "shared", "fp").unionByName(again)
    shards = shards.repartition("way", "shared").sortWithinPartitions("way", "shared", "fp")
    return shards.mapInArrow(_shards(radius), T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))


def hex_print(col: str) -> Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id``, the least id among all documents reachable over links.

    Null or blank text: fingerprint zero, linked like any other. Repeated rows stay; a null id takes the least other id of
    its component, null if there is none. Other columns are ignored. Copies are collapsed to one fingerprint before
    linking, so a large group of copies costs one node."""
    prints = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), size).alias("fp")), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(fingerprint_links(nodes, radius, "fp"))
    labelled = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    known = labelled.join(lowest, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", hex_print("fp").alias("fingerprint"), "component_id")
