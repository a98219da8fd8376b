"""Paired tests, agreement, medians and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def paired(results: DataFrame, first: str = "a", second: str = "c", keys: tuple[str, ...] = ("item_id", "model", "prompt_condition")) -> DataFrame:
    """(keys..., first, second): both levels' correctness of an item; NULL where a level is absent or unparsed."""
    wide = results.where(F.col("level").isin(first, second)).groupBy(*keys).pivot("level", [first, second]).agg(F.max("correct"))
    return wide.select(*keys, F.col(first).alias("first"), F.col(second).alias("second"))


def mcnemar(pairs: DataFrame, *by: str) -> DataFrame:
    """(by..., n, only_first, only_second, statistic): McNemar's chi-square with the continuity correction over pairs parsed on both
    sides; NULL without discordant pairs."""
    both = pairs.where("first is not null and second is not null")
    b, c = F.count_if(F.col("first") & ~F.col("second")), F.count_if(~F.col("first") & F.col("second"))
    counted = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), b.alias("only_first"), c.alias("only_second"))
    d = F.abs(F.col("only_first") - F.col("only_second")) - 1
    return counted.withColumn("statistic", F.try_divide((F.greatest(F.lit(0), d) * F.greatest(F.lit(0), d)).cast("double"), F.col("only_first") + F.col("only_second")))


def cohen_kappa(rated: DataFrame, one: str, two: str, *by: str) -> DataFrame:
    """(by..., n, kappa) of two raters' labels; rows that either left NULL do not count; NULL where chance agreement is complete.

    Label counts come from two aggregations over (by, label) pairs, so no label set is collected.
    """
    rows = rated.where(F.col(one).isNotNull() & F.col(two).isNotNull())
    cells = rows.groupBy(*by, F.col(one).cast("string").alias("__x"), F.col(two).cast("string").alias("__y")).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("__x") == F.col("__y"), F.col("n")).otherwise(0)).alias("agree"))
    marginal = cells.select(*by, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("__x").alias("label"), "n"), F.struct(F.lit(2).alias("side"), F.col("__y").alias("label"), "n"))).alias("m"))
    sides = marginal.groupBy(*by, F.col("m.label").alias("__label")).agg(F.sum(F.when(F.col("m.side") == 1, F.col("m.n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("m.side") == 2, F.col("m.n")).otherwise(0)).alias("q"))
    chance = sides.groupBy(*by).agg(F.sum(F.col("p") * F.col("q")).alias("chance"))
    joined = totals.join(chance, list(by)) if by else totals.crossJoin(chance)
    n, agree, by_chance = F.col("n"), F.col("agree"), F.col("chance")
    return joined.select(*by, "n", F.try_divide((agree * n - by_chance).cast("double"), n * n - by_chance).alias("kappa"))


def median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., median): exact."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))


def shift_gate(left: DataFrame, right: DataFrame, value: str, *, least: float | None = None, most: float | None = None) -> DataFrame:
    """One row: both medians, their difference and whether it passes: more than ``least``, or at most ``most`` in size."""
    joined = left.agg(F.percentile(value, F.lit(0.5)).alias("left_median")).crossJoin(right.agg(F.percentile(value, F.lit(0.5)).alias("right_median")))
    delta = F.col("left_median") - F.col("right_median")
    ok = F.lit(True)
    ok = ok if least is None else ok & (delta > least)
    ok = ok if most is None else ok & (F.abs(delta) <= most)
    return joined.withColumns({"delta": delta, "passes": ok})


def jargon_scores(texts: DataFrame, scorer, text_col: str = "text") -> DataFrame:
    """``texts`` with ``jargon``: scorer() gives, once per task, a callable(list of texts) -> list of scores; null texts have none."""

    def run(frames):
        score = scorer()
        for pdf in frames:
            known = pdf[text_col].notna()
            pdf["jargon"] = None
            pdf.loc[known, "jargon"] = score(pdf.loc[known, text_col].tolist())
            pdf["jargon"] = pdf["jargon"].astype("float64")
            yield pdf

    return texts.mapInPandas(run, StructType([*texts.schema.fields, StructField("jargon", DoubleType())]))


def drop_rate(attempts: DataFrame, most: int = 3) -> DataFrame:
    """One row: items, dropped and drop_rate of regeneration attempts (item_id, attempt, passed): an item is dropped if none of its first
    ``most`` attempts passed."""
    items = attempts.where(F.col("attempt") <= most).groupBy("item_id").agg(F.coalesce(F.bool_or("passed"), F.lit(False)).alias("ok"))
    return items.agg(F.count(F.lit(1)).alias("items"), F.count_if(~F.col("ok")).alias("dropped"), F.coalesce(F.avg((~F.col("ok")).cast("int")), F.lit(0.0)).alias("drop_rate"))


def last_attempts(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(item_id, attempt, passed): each item's first passing attempt among the first ``most``, else its last one of these."""
    rows = attempts.where(F.col("attempt") <= most)
    rank = F.struct(F.coalesce("passed", F.lit(False)).alias("ok"), F.when(F.coalesce("passed", F.lit(False)), -F.col("attempt")).otherwise(F.col("attempt")).alias("place"))
    best = rows.groupBy("item_id").agg(F.max_by(F.struct("attempt", F.coalesce("passed", F.lit(False)).alias("passed")), rank).alias("b"))
    return best.select("item_id", "b.attempt", "b.passed")


def rater_gate(judgements: DataFrame, most: float = 0.75) -> DataFrame:
    """One row: how often raters told rewrites from real texts (guess = truth), and whether that is at most ``most``."""
    share = F.coalesce(F.avg((F.col("guess") == F.col("truth")).cast("int")), F.lit(0.0))
    return judgements.agg(F.count(F.lit(1)).alias("n"), share.alias("rater_accuracy"), (share <= most).alias("passes"))
