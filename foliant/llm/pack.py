"""Best-fit packing by minimum bin slack.

Only how many pieces have each length matters for a packing, and there are at most ``capacity`` lengths, so the
packing itself is planned on the driver from that histogram: for each bin the longest piece left is taken, a bitset
subset-sum program over the available lengths finds the fullest feasible combination around it, and the combination
is removed, as often at once as the counts allow. The plan has a bounded number of rows; pieces find their place in it
by their rank among pieces of the same length, which is counted in salted groups.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import materialise
from .tokens import default_vocabulary, token_bytes

CAPACITY, END_ID = 1024, 2
#: Pieces of one length that one task ranks.
GROUP = 50_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Uses of each length whose sum is the largest that fits into ``room``, longer lengths first among equals."""
    lengths = [n for n in sorted(counts) if n <= room and counts[n] > 0]
    keep = (1 << (room + 1)) - 1
    reach = [1]
    for n in lengths:
        now, left, step = reach[-1], min(counts[n], room // n), 1
        while left > 0:
            take = min(step, left)
            now |= now << (n * take) & keep
            left, step = left - take, step * 2
        reach.append(now)
    target, uses = reach[-1].bit_length() - 1, {}
    for i in range(len(lengths) - 1, -1, -1):
        n = lengths[i]
        for k in range(min(counts[n], target // n), -1, -1):
            if reach[i] >> (target - k * n) & 1:
                if k:
                    uses[n] = k
                target -= k * n
                break
    return uses


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, first rank, end rank, uses in a bin, first bin, offset in the bin)`` of a packing of all pieces."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(counts, 0)
    bins, rows = 0, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        uses = fullest(counts, capacity - longest)
        counts[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in uses.items())
        offset = 0
        for n, k in sorted(uses.items(), reverse=True):
            rows.append((n, used[n], used[n] + k * times, k, bins, offset))
            used[n] += k * times
            offset += n * k
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        bins += times
    return rows


_PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """Pieces of one document's ids (4 bytes each): the first takes what full ones leave over."""
    total = len(ids) // 4
    first = total % capacity or min(total, capacity)
    cuts = [0, *range(first, total + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str | None) -> DataFrame:
    end = END_ID.to_bytes(4, "little")

    @F.pandas_udf(_PIECES)
    def cut(text: pd.Series) -> pd.Series:
        path = vocabulary or default_vocabulary()
        names = ("piece", "start", "length", "ids_crc32")
        return pd.Series([[dict(zip(names, p, strict=True)) for p in pieces_of(token_bytes(t, path) + end, capacity)] for t in text])

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(cut(F.col(text_col))).alias("p")).select("doc_id", "p.*")


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``doc_id``, ``piece``, ``length`` up to ``capacity``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = {r["length"]: r["count"] for r in counted}
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    rows = plan(histogram, capacity)
    steps = spark.createDataFrame(pd.DataFrame(rows, columns=["at_length", "first", "last", "uses", "bin", "at"]).astype("int64"))
    salts = {n: -(-c // GROUP) for n, c in histogram.items() if c > GROUP}
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in salts.items() for x in kv]), F.col("length").cast("int")), F.lit(1)) if salts else F.lit(1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), many).cast("int"))
    below = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("before"))
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(w) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    met = ranked.join(F.broadcast(steps), (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    place = F.col("rank") - F.col("first")
    return met.select(*pieces.columns, (F.col("bin") + F.floor(place / F.col("uses"))).cast("long").alias("sequence_id"), (F.col("at") + place % F.col("uses") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """All documents as pieces placed into sequences of at most ``capacity`` tokens.

    Null text: the end id alone. Repeated rows are packed once each; an empty table gives an empty result; other columns
    are ignored. ``vocabulary``: path of the rank file on every machine, else the public one that is installed."""
    return placed(materialise(tokenised_pieces(docs, id_col, text_col, capacity, vocabulary), "pieces"), capacity)
