"""Merkle manifest of a dataset: one tree of digests for each group of rows, a root over all groups, and a proof for every row.

The trees are built from events, as ``combineByKey`` would: a digest that arrives joins the partial parent that its place belongs to; a parent that
holds as many children as the size of its level says is complete, is written down as a link, and becomes an event itself. Rows come
range-sorted, so a task completes nearly all parents of its rows and holds a few partial ones for each level. What it could not complete is its
frontier: those digests are shuffled by larger and larger subtrees until only roots are left. Proofs go the other way, along the links, a block of
``HEIGHT`` levels at a time, so that no task holds more than ``ARITY ** HEIGHT`` rows of a tree at once, however large that is.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt_in_order, discard, materialise, with_positions

#: Children of a node.
ARITY = 8
#: Levels between a block's rows and its root when proofs are made, and by which frontiers meet.
HEIGHT = 4
_SHIFT = ARITY.bit_length() - 1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Kinds of rows that building trees writes.
LINK, FRONTIER, ROOT = range(3)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 in hex of some values: ``-`` for null, else the UTF-8 bytes' count, a colon and the value."""
    text = [f.cast("string") for f in fields]
    said = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def node_digest(kids: list[bytes]) -> bytes:
    """Digest of a node, from those of its children as hex text."""
    return sha256(b"".join(kids).hex().encode()).digest()


def level_size(leaves: int, level: int) -> int:
    """Nodes of a level of a tree; a level of one node is its root."""
    return -(-leaves // ARITY**level)


def height(leaves: Column) -> Column:
    """The level of a tree's root."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda k: F.pow(F.lit(float(ARITY)), k) < leaves))


def split(kids: bytes) -> list[bytes]:
    return [kids[i : i + 32] for i in range(0, len(kids), 32)]


# --- upwards: trees ------------------------------------------------------------------------------------------------

_EVENT = T.StructType([T.StructField("kind", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("tree", "leaves", "level", "place")] + [T.StructField("data", T.BinaryType())])
_ARROW = pa.schema([("kind", pa.int32()), *[(n, pa.int64()) for n in ("tree", "leaves", "level", "place")], ("data", pa.binary())])


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``tree, leaves, level, place, data`` as events: links of completed parents, roots, and at the end what no parent could use yet."""
    partial: dict[tuple[int, int, int, int], dict[int, bytes]] = {}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(_ARROW.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in _ARROW.names}, schema=_ARROW)

    for b in batches:
        out = []
        for tree, leaves, level, place, digest in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            while (size := level_size(leaves, level)) > 1:
                parent = place // ARITY
                key = (tree, leaves, level + 1, parent)
                kids = partial.setdefault(key, {})
                kids[place % ARITY] = digest
                if len(kids) < min(ARITY, size - parent * ARITY):
                    break
                del partial[key]
                ordered = [kids[i] for i in range(len(kids))]
                digest, level, place = node_digest(ordered), level + 1, parent
                out.append((LINK, tree, leaves, level, place, b"".join(ordered)))
            else:
                out.append((ROOT, tree, leaves, level, place, digest))
        yield batch(out)
    left = [(FRONTIER, tree, leaves, level - 1, parent * ARITY + i, digest) for (tree, leaves, level, parent), kids in partial.items() for i, digest in kids.items()]
    for i in range(0, len(left), 10_000):
        yield batch(left[i : i + 10_000])


class Forest(NamedTuple):
    """``links``: ``tree, leaves, level, place`` of inner nodes and, as ``data``, their children's digests; ``roots``: the same of roots, with their own digest."""

    links: DataFrame
    roots: DataFrame


def forest(leaves: DataFrame) -> Forest:
    """Trees over ``tree, leaves`` (how many the tree has), ``place`` and ``data`` (the digest). Rows should come sorted by tree and place; any order is right."""
    events = leaves.select("tree", "leaves", F.lit(0).cast("long").alias("level"), "place", "data")
    passes, step = [], 0
    while True:
        done = materialise(events.mapInArrow(_climb, _EVENT), "climbed")
        passes.append(done)
        frontier = done.where(F.col("kind") == FRONTIER).drop("kind")
        if frontier.isEmpty():
            break
        step += 1
        first = F.expr(f"shiftleft(place, cast({_SHIFT} * level as int))")
        events = frontier.repartition("tree", F.shiftright(first, min(_SHIFT * HEIGHT * step, 63))).sortWithinPartitions("tree", first, "level")
    both = passes[0]
    for more in passes[1:]:
        both = both.unionByName(more)
    of = lambda kind: both.where(F.col("kind") == kind).drop("kind")
    return Forest(of(LINK), of(ROOT))


# --- downwards: proofs ---------------------------------------------------------------------------------------------


def run_of(place: int, kids: list[bytes]) -> bytes:
    """A step of a path: the place within the run, the number of siblings, and these."""
    at = place % ARITY
    return bytes([at, len(kids) - 1]) + b"".join(kids[:at] + kids[at + 1 :])


def runs(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Places and siblings along a path."""
    i = 0
    while i < len(path):
        end = i + 2 + 32 * path[i + 1]
        yield path[i], split(path[i + 2 : end])
        i = end


def proof_digest(path: bytes) -> bytes:
    """Digest of all siblings along a path, as hex text."""
    return sha256(b"".join(s for _, siblings in runs(path) for s in siblings).hex().encode()).digest()


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its siblings lead to."""
    for at, siblings in runs(path):
        digest = node_digest([*siblings[:at], digest, *siblings[at:]])
    return digest


def _paths_in_block(given: pa.Table, lowest: int) -> tuple[dict[int, bytes], bytes | None]:
    """Paths by place of a block's nodes on the level ``lowest``, and what is known about their tree. ``given``: ``level, place, data, about`` of inner nodes (their
    children) and of the block's root (its path); ``about`` is null but there."""
    rows = list(zip(*(given.column(n).to_pylist() for n in ("level", "place", "data", "about")), strict=True)) if given.num_rows else []
    kids = {(level, place): split(data) for level, place, data, about in rows if about is None}
    for level, place, path, about in rows:
        if about is not None:
            paths = {place: path}
            for at in range(level, lowest, -1):
                paths = {p * ARITY + i: run_of(i, kids[at, p]) + above for p, above in paths.items() for i in range(len(kids[at, p]))}
            return paths, about
    return {}, None  # the root of the tree is on this level: it is a block's root in the next step


def _block_paths(lowest: int, place: str, keep: list[str]):
    def of(nodes: pa.Table, given: pa.Table) -> pa.Table:
        paths, about = _paths_in_block(given, lowest)
        nodes = nodes if paths else nodes.slice(0, 0)
        found = [paths[p] for p in nodes.column(place).to_pylist()]
        return pa.table({c: nodes.column(c) for c in keep} | {"path": pa.array(found, pa.binary()), "about": pa.array([about] * len(found), pa.binary())})

    return of


def paths(leaves: DataFrame, trees: Forest, tops: DataFrame, tallest: int) -> DataFrame:
    """The columns of ``leaves`` (``tree, place`` and others) with ``path``, the siblings from each leaf up to the root over its tree's root, and ``about``.

    ``tops``: ``tree, leaves`` of each tree, with the path ``data`` above its root and ``about``, bytes that all its rows get. ``tallest``: the height of the tallest tree."""
    tops = materialise(tops.select("tree", height(F.col("leaves")).cast("long").alias("level"), F.lit(0).cast("long").alias("place"), "data", "about"), "tops")
    links = trees.links.select("tree", "level", "place", "data", F.lit(None).cast("binary").alias("about"))
    upper = None
    for base in range(HEIGHT * max(0, -(-tallest // HEIGHT) - 1), -1, -HEIGHT):
        here = (F.col("level") > base) & (F.col("level") <= base + HEIGHT)
        given = links.where(here).unionByName(tops.where(here if base else F.col("level") <= HEIGHT))
        given = given if upper is None else given.unionByName(upper)
        given = given.withColumn("block", F.expr(f"shiftright(place, cast({_SHIFT} * ({base + HEIGHT} - level) as int))"))
        # other names than on the other side, which may be read from the same table
        nodes = leaves if not base else trees.links.where(F.col("level") == base).select(F.col("tree").alias("own_tree"), F.col("place").alias("own_place"))
        tree, place = ("own_tree", "own_place") if base else ("tree", "place")
        blocks = nodes.withColumn("own_block", F.shiftright(place, _SHIFT * HEIGHT)).groupBy(tree, "own_block").cogroup(given.groupBy("tree", "block"))
        out = blocks.applyInArrow(_block_paths(base, place, nodes.columns), T.StructType([*nodes.schema, *(T.StructField(n, T.BinaryType()) for n in ("path", "about"))]))
        if base:
            upper = out.select(F.col("own_tree").alias("tree"), F.lit(base).cast("long").alias("level"), F.col("own_place").alias("place"), F.col("path").alias("data"), "about")
            upper = materialise(upper, "paths")
    return out


# --- the manifest --------------------------------------------------------------------------------------------------


def tampering(doc_id: Column) -> Column:
    """Which rows the registered query tampers with: those whose decimal id has a CRC-32 that 3 divides. A null id has none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


@F.pandas_udf(T.StructType([T.StructField(n, T.BinaryType()) for n in ("proof", "folded")]))
def _proved(path: pd.Series, digest: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(proof_digest(p), folded(d, p)) for p, d in zip(path, digest, strict=True)], columns=["proof", "folded"])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "lang", id_col: str = "doc_id", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, proof, told, folded`` of every row, digests as bytes: its leaf, the root of its group, the root over all groups (in the order
    of their values, null first), the siblings on the way up, their digest, the leaf that is told again, and the root that it leads to.

    A leaf is the digest of ``fields``. Where ``tampered`` holds, the leaf told has A-Z of the text lower-cased; a null text stays. Leaves of a group are in the order of ids,
    null last, and of digests: rows of one id are leaves of their own, and rows alike in all fields take the places of their equal leaves in any order. A null group is a
    group. An empty table gives no rows. Texts are read once; columns beside ``fields`` are ignored."""
    c = [F.col(f) for f in fields]
    lower = [F.translate(F.col(f), UPPER, LOWER) if f == text_col else F.col(f) for f in fields]
    changed = tampering(F.col(id_col)) if tampered is None else tampered
    told = F.when(changed & F.col(text_col).isNotNull(), F.unhex(leaf_digest(lower)))
    rows = docs.select(F.col(by).alias("group"), F.col(id_col).alias("doc_id"), F.unhex(leaf_digest(c)).alias("data"), told.alias("told"))
    rows = materialise(rows, "hashed")  # so that sampling for ranges doesn't read the texts again
    dealt, parts = dealt_in_order(rows, [F.col("group").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), F.col("data"), F.col("told")], ["group"], "leaves")
    groups = parts.groupBy(F.col("of_group").alias("group")).agg(F.max("total").alias("leaves"))
    groups = with_positions(*dealt_in_order(groups, [F.col("group").asc_nulls_first()], [], "groups"), []).select(F.col("group").alias("its"), F.col("position").alias("tree"), F.col("total").alias("trees"), "leaves")
    groups = materialise(groups, "trees")
    parts = parts.join(groups.select("its", "tree"), F.col("of_group").eqNullSafe(F.col("its"))).drop("its")
    leaves = with_positions(dealt, parts, ["group"]).select("tree", F.col("total").alias("leaves"), F.col("position").alias("place"), "data", "told", "doc_id")
    leaves = materialise(leaves.sortWithinPartitions("tree", "place"), "leaf")
    discard(rows, dealt)
    trees = forest(leaves)
    tops = trees.roots.join(groups.select("tree", "trees"), "tree").select(F.lit(0).cast("long").alias("tree"), F.col("trees").alias("leaves"), F.col("tree").alias("place"), "data", F.col("leaves").alias("own_leaves"))
    tops = materialise(tops, "subroots")
    top = forest(tops)
    most = groups.agg(F.max(height(F.col("leaves"))), F.max(height(F.col("trees")))).first()
    if most[0] is None:
        return leaves.select("doc_id", *[F.col("data").alias(n) for n in ("leaf", "subroot", "root", "path", "proof", "told", "folded")])
    above = paths(tops, top, top.roots.select("tree", "leaves", F.lit(b"").alias("data"), F.col("data").alias("about")), most[1])
    above = above.select(F.col("place").alias("tree"), F.col("own_leaves").alias("leaves"), F.col("path").alias("data"), F.concat("data", "about").alias("about"))
    found = paths(leaves.select("tree", "place", "data", "told", "doc_id"), trees, above, most[0])
    again = F.coalesce("told", "data")
    out = found.withColumn("x", _proved("path", again))
    return out.select("doc_id", F.col("data").alias("leaf"), F.substring("about", 1, 32).alias("subroot"), F.substring("about", 33, 32).alias("root"), "path", F.col("x.proof").alias("proof"), again.alias("told"), F.col("x.folded").alias("folded"))


def digest(found: DataFrame) -> DataFrame:
    """The manifest in hex, and whether each row's leaf, as told, still leads to the root."""
    text = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", *[text(c).alias(c) for c in ("leaf", "subroot", "root")], text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
