"""Cost of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MILLION = 1_000_000


def call_cost(input_tokens: Column, output_tokens: Column, rate_in: Column, rate_out: Column) -> Column:
    """USD at rates per million tokens; NULL if either rate is; 0.0 is a price."""
    return input_tokens / F.lit(float(MILLION)) * rate_in + output_tokens / F.lit(float(MILLION)) * rate_out


def price(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """``calls`` with cost_usd from ``rates`` (model, input, output): a driver-side configuration table, one row per
    configured model, so it is small by construction and broadcast.  Unknown models and incomplete rates give NULL."""
    r = F.broadcast(rates.select(F.col("model").alias("__m"), F.col("input").alias("__in"), F.col("output").alias("__out")))
    joined = calls.drop("cost_usd").join(r, F.col("model") == F.col("__m"), "left")
    return joined.withColumn("cost_usd", call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("__in"), F.col("__out"))).drop("__m", "__in", "__out")
