"""Connected components of an edge table, by alternating large and small stars; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges ``u > v`` drawn towards the least neighbour: of the larger neighbours (large), or of the smaller ones and the node."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        drawn = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        drawn = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return drawn.where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node but the roots themselves.

    Edges may be repeated, in either direction, loops, or have nulls (ignored); an empty table gives an empty result.
    Each round's edges are written to shared storage, so that neither lineage nor a lost executor's work grows; hubs
    are met by partial aggregation and by joins that adaptive execution can split. Only a count and a checksum reach
    the driver."""
    edges = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v")
    edges = materialise(edges.distinct(), "edges")
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        last, edges = edges, materialise(_star(_star(edges, True), False), "edges")
        discard(last)
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
