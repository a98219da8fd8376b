"""Rollups of a call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import STAGES


def check_stages(calls: DataFrame) -> DataFrame:
    """``calls`` that fails at run time on a stage that is not in STAGES."""
    ok = F.col("stage").isin(*STAGES)
    message = F.concat(F.lit(f"stage must be one of {', '.join(sorted(STAGES))}, got "), F.coalesce("stage", F.lit("NULL")))
    return calls.withColumn("stage", F.when(ok, F.col("stage")).otherwise(F.raise_error(message)))


def _measures():
    return [
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced"),
    ]


def summarize(calls: DataFrame) -> DataFrame:
    """(scope, name, calls, input_tokens, output_tokens, usd, unpriced): one row per stage, per model and in all.

    One pass: three grouping sets, aggregated before the shuffle.  usd sums what has a price and is 0.0 if nothing has;
    an empty log gives no rows.
    """
    grouped = calls.groupingSets([[F.col("stage")], [F.col("model")], []], F.col("stage"), F.col("model")).agg(F.grouping_id().alias("g"), *_measures())
    scope = F.when(F.col("g") == 1, "stage").when(F.col("g") == 2, "model").otherwise("total")
    name = F.when(F.col("g") == 1, F.col("stage")).when(F.col("g") == 2, F.col("model"))
    return grouped.where("calls > 0").select(scope.alias("scope"), name.alias("name"), "calls", "input_tokens", "output_tokens", "usd", "unpriced")


def project(calls: DataFrame, scale: float) -> DataFrame:
    """One row: total_calls, total_usd, unpriced and projected_usd = total_usd * scale; 0.0 for an empty log."""
    totals = calls.agg(F.count(F.lit(1)).alias("total_calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced"))
    return totals.withColumn("projected_usd", F.col("total_usd") * float(scale))


def without_rate(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, lacks) of every model of the log whose rate is missing ("rate") or has one side only ("input", "output")."""
    known = rates.select(F.col("model").alias("rated"), "input", "output")
    used = calls.select("model").distinct().join(F.broadcast(known), F.col("model").eqNullSafe(F.col("rated")), "left")
    lacks = F.when(F.col("rated").isNull() | (F.col("input").isNull() & F.col("output").isNull()), "rate").when(F.col("input").isNull(), "input").when(F.col("output").isNull(), "output")
    return used.select("model", lacks.alias("lacks")).where("lacks is not null")
