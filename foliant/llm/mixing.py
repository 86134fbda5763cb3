"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent between 0 (all alike) and 1 (as they are); the exponent is
bisected to the largest one whose mixture reaches a target entropy, and raised again where it would repeat a source
more often than allowed. The budget lets every source appear at least once in whole, so no document is lost: a source
whose weight exceeds its share is repeated, in whole epochs and a last partial one. Within each epoch a source's
documents stand in a pseudo-random order of blocks, and the mixture deals all sources out in proportion, block by block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise

#: Share of the greatest possible entropy to reach; most repetitions of a source; tokens of one block of a source.
TARGET_ENTROPY, MOST_REPEATS, BLOCK_TOKENS = 0.93, 2.0, 1 << 20
#: Exponents tried at once, and rounds: the exponent is known to ``SECTIONS ** -ROUNDS``.
SECTIONS, ROUNDS = 64, 4
SEED = 17


def word_tokens(text: Column) -> Column:
    """Words of the text, at least one: the measure of a document where no tokenizer is named."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+"), F.lit(0)))).cast("long")


def exponent(sources: DataFrame, target: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS) -> float:
    """The exponent for a table of ``source, tokens``: the largest that reaches the target share of the greatest entropy,
    or the least that keeps within the repetition limit if that is larger. Only sums over sources reach the driver."""
    totals = sources.where("tokens > 0").agg(F.sum("tokens"), F.count(F.lit(1)), F.max("tokens"), F.min("tokens")).first()
    if not totals[0] or totals[1] < 2:
        return 1.0
    share = F.col("tokens") / F.lit(float(totals[0]))

    def search(good, rising: bool) -> float:
        """The end of the exponents that are good: entropy falls as the exponent grows, repetitions fall as well."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            rows = good(grid)
            ok = [i for i in range(SECTIONS + 1) if rows[i]]
            if not ok:
                return high if rising else low
            at = min(ok) if rising else max(ok)
            if rising:
                low, high = grid[max(at - 1, 0)], grid[at]
            else:
                low, high = grid[at], grid[min(at + 1, SECTIONS)]
        return high if rising else low

    def entropies(grid: list[float]) -> list[bool]:
        sums = sources.where("tokens > 0").agg(*[x for t in grid for x in (F.sum(F.pow(share, F.lit(t))), F.sum(F.pow(share, F.lit(t)) * F.log(share)))]).first()
        bound = target * math.log(totals[1])
        return [round(math.log(sums[2 * i]) - t * sums[2 * i + 1] / sums[2 * i], 9) >= round(bound, 9) for i, t in enumerate(grid)]  # rounded: sums may differ in their last bits

    # the most repeated source is the smallest: its repetitions over those of the largest are (min/max) ** (t - 1)
    ratio = totals[3] / totals[2]
    entropy_end = search(entropies, rising=False)
    repeat_end = search(lambda grid: [ratio ** (t - 1) <= most_repeats + 1e-12 for t in grid], rising=True)
    return max(entropy_end, repeat_end)


def weights(docs: DataFrame, tau: float | None = None, target: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """``source, tokens, weight, budget`` from a table of ``source, tokens`` of documents. The budget of the whole is such
    that the source with the largest share appears once."""
    sources = materialise(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    tau = exponent(sources, target, most_repeats) if tau is None else tau
    top = float(sources.agg(F.max("tokens")).first()[0] or 1)
    raised = sources.withColumn("raised", F.pow(F.col("tokens") / F.lit(top), F.lit(tau)))
    total = float(raised.agg(F.sum("raised")).first()[0] or 1)
    weight = F.round(F.col("raised") / F.lit(total), 12)
    return raised.select("source", "tokens", weight.alias("weight"), F.greatest("tokens", F.round(F.col("raised") * F.lit(top)).cast("long")).alias("budget"))


def _order(seed: int, *cols: str | Column) -> Column:
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """``doc_id, print, source, tokens, weight, epoch, position, place``, a row for each time a document stands in the mixture.

    ``print``: a hash of the text; ``position``: tokens of the source before the document in its permuted blocks, over all epochs; ``place``: the same as a
    share of the source's budget, so that ordering by it deals the sources out by weight. Epoch 0 holds every document;
    the last epoch of a source ends where its budget does. Null sources form a source of their own, null or empty texts
    count one token, and repeated rows stand for themselves. A hot source is split into blocks of about ``BLOCK_TOKENS``
    by a hash; only blocks are ordered across a source."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_tokens(F.col(text_col)).alias("tokens"), F.xxhash64(F.col(text_col)).alias("print"))
    base = materialise(base, "measured")
    weighed = materialise(weights(base, target=target, most_repeats=most_repeats), "weights")
    shares = weighed.select(F.col("source").alias("s"), F.col("tokens").alias("source_tokens"), "weight", "budget")
    rows = base.join(shares, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    block = F.pmod(_order(seed, "doc_id", "print"), F.ceil(F.col("source_tokens") / F.lit(BLOCK_TOKENS)).cast("long"))
    rows = rows.withColumn("block", block).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("budget") / F.col("source_tokens")).cast("int") - 1)))
    inner = Window.partitionBy("source", "epoch", "block").orderBy(_order(seed + 1, "doc_id", "print", "epoch"), "doc_id", "print").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    shuffled = Window.partitionBy("source", "epoch").orderBy(_order(seed + 2, "block", "epoch"), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("size")).withColumn("start", F.coalesce(F.sum("size").over(shuffled), F.lit(0)))
    here = blocks.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), "start")
    met = rows.join(here, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")))
    position = F.col("epoch") * F.col("source_tokens") + F.col("start") + F.col("before")
    out = met.withColumn("position", position).where((F.col("epoch") == 0) | (F.col("position") + F.col("tokens") <= F.col("budget")))
    return out.select("doc_id", "print", "source", "tokens", "weight", "epoch", "position", (F.col("position") / F.col("budget")).alias("place"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their own columns, as often as they stand in the mixture; every row at least once. Rows that
    share an id and a text share their copies alike, rounded up."""
    times = mix(docs, id_col, source_col, text_col, **options).groupBy("doc_id", "print")
    times = times.agg(F.ceil(F.count(F.lit(1)) / F.sum((F.col("epoch") == 0).cast("int"))).cast("int").alias("_times"))
    times = times.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "_times")
    met = docs.join(times, F.col(id_col).eqNullSafe(F.col("_id")) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col("_print")))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*docs.columns)
