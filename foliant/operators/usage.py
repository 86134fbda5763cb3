"""Token usage and cost (A1 to A6, J13, S30). Sums group by small keys, so partial aggregation carries the weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS = ("input_tokens", "cached_input_tokens", "output_tokens", "cache_write_tokens")
#: Names under which providers report each count; the first that is there counts.
USAGE_FIELDS = {
    "input_tokens": ("input_tokens", "prompt_tokens", "prompt_eval_count"),
    "output_tokens": ("output_tokens", "completion_tokens", "eval_count"),
    "cached_input_tokens": ("cache_read_input_tokens", "input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens"),
    "cache_write_tokens": ("cache_creation_input_tokens",),
}


def usage_from_json(raw: Column) -> Column:
    """Struct of the four counts from a provider's usage object."""
    get = lambda names: F.coalesce(*[F.get_json_object(raw, f"$.{n}").cast("long") for n in names], F.lit(0).cast("long"))
    return F.struct(*[get(names).alias(k) for k, names in USAGE_FIELDS.items()])


def usage_by(ledger: DataFrame, *keys: str) -> DataFrame:
    """Sums of the counts that the ledger has, by any keys: page and model, document and model, model (A1, A2)."""
    return ledger.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in TOKENS if c in ledger.columns])


def usage_with_total(ledger: DataFrame, key: str = "model_id") -> DataFrame:
    """Sums by model and over all, in one pass (A5)."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in TOKENS if c in ledger.columns]
    return ledger.groupingSets([[key], []], key).agg(F.grouping(key).alias("is_total"), *sums).select(F.when(F.col("is_total") == 1, "Total").otherwise(F.col(key)).alias(key), *[c for c in TOKENS if c in ledger.columns])


def first_writes(ledger: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each job (A3)."""
    return ledger.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def model_cost(input_tokens: Column, cached: Column, output_tokens: Column, price_in: Column, price_out: Column, price_cached: Column) -> Column:
    """Dollars, from prices for a million tokens. Cached tokens are cut to the input; a cached price of zero or null means the input price (A4)."""
    i = F.greatest(F.coalesce(input_tokens, F.lit(0)), F.lit(0))
    c = F.least(F.greatest(F.coalesce(cached, F.lit(0)), F.lit(0)), i)
    rate = F.coalesce(F.nullif(price_cached, F.lit(0)), price_in)
    d = lambda x: x.cast("double")
    return (d(i - c) * d(price_in) + d(c) * d(rate) + d(F.greatest(F.coalesce(output_tokens, F.lit(0)), F.lit(0))) * d(price_out)) / F.lit(1e6)


def costed(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Usage by ``model_id`` with its cost; models out of the catalog cost nothing (J13). The catalog's size decides the join."""
    met = usage.join(catalog, "model_id", "left")
    cost = model_cost(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out"), F.col("price_cached"))
    return met.withColumn("cost", F.when(F.col("price_in").isNull(), 0.0).otherwise(cost)).drop("price_in", "price_out", "price_cached")


def batch_summary(outcomes: DataFrame, usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each file of a batch with its status, pages, engine, cost and error, and a last row with the total cost.

    ``outcomes``: ``file_id, filename, pages, engine, ai_model, error``, failed if there is an error. A file without a model costs nothing that is known: null, as does
    one whose model the catalog lacks (J13)."""
    known = catalog.select(F.col("model_id").alias("ai_model"), F.lit(True).alias("known"))
    cost = costed(usage_by(usage, "file_id", "model_id"), catalog).groupBy("file_id").agg(F.sum("cost").alias("spent"))
    met = outcomes.join(known, "ai_model", "left").join(cost, "file_id", "left")
    ok = F.col("error").isNull()
    rows = met.select(
        "file_id", "filename", F.when(ok, "Completed").otherwise("Failed").alias("status"), F.when(ok, F.col("pages")).cast("int").alias("pages"), F.when(ok, F.col("engine")).alias("engine"),
        F.when(ok & F.col("known"), F.coalesce("spent", F.lit(0.0))).alias("cost"), F.coalesce("error", F.lit("")).alias("error"),
    )
    total = rows.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost")).select(*[F.lit("Total").cast("string").alias(c) if c == "filename" else F.col(c) if c == "cost" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return rows.unionByName(total)


def audit_summary(calls: DataFrame) -> DataFrame:
    """Model calls by model and status."""
    return calls.groupBy("model", "status").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.avg("latency_ms").alias("mean_latency_ms"))
