"""Accuracy, rates, verdicts and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_RATE = 0.05


def accuracy(results: DataFrame, *by: str) -> DataFrame:
    """(by..., n, scored, correct, accuracy, unparseable, parse_fail_rate): accuracy is over parsed answers only, and 0.0 without any."""
    n, right = F.count(F.lit(1)), F.count_if("correct")
    scored, lost = F.count("predicted"), F.count_if(F.col("predicted").isNull())
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return results.groupBy(*by).agg(
        n.alias("n"), scored.alias("scored"), right.alias("correct"), share(right, scored).alias("accuracy"), lost.alias("unparseable"), share(lost, n).alias("parse_fail_rate")
    )


def sanity_summary(attempts: DataFrame) -> DataFrame:
    """(model_id, n, errored, accuracy, parse_fail_rate, error_rate) of rows (model_id, status, predicted, correct); status is 'run' or 'failed'."""
    failed = F.col("status") == "failed"
    lost = F.count_if(~failed & F.col("predicted").isNull())
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return attempts.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(failed).alias("errored"),
        share(F.count_if(~failed & F.col("correct")), F.count_if(~failed & F.col("predicted").isNotNull())).alias("accuracy"),
        share(lost, F.count_if(~failed)).alias("parse_fail_rate"),
        share(F.count_if(failed), F.count(F.lit(1))).alias("error_rate"),
    )


def verdicts(summary: DataFrame, targets: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """``summary`` with min_acc, max_acc, point and verdict: PASS, CHECK or N/A.

    ``targets`` is a configuration table (a row per model), so it is broadcast.  A model without a row needs a look; one whose row has
    no point has no target, but its rates still count; bands include their ends.
    """
    t = F.broadcast(targets.select("model_id", "min_acc", "max_acc", "point", F.lit(True).alias("__known")))
    healthy = (F.col("parse_fail_rate") <= max_rate) & (F.col("error_rate") <= max_rate)
    within = F.col("accuracy").between(F.col("min_acc"), F.col("max_acc"))
    verdict = (
        F.when(F.col("__known").isNull(), "CHECK")
        .when(F.col("point").isNull(), F.when(healthy, "N/A").otherwise("CHECK"))
        .otherwise(F.when(within & healthy, "PASS").otherwise("CHECK"))
    )
    return summary.join(t, "model_id", "left").withColumn("verdict", verdict).drop("__known")


def exit_code(judged: DataFrame) -> int:
    """0 if no verdict is CHECK, 1 if one is, 2 if no model was run."""
    row = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "CHECK").alias("bad")).first()
    return 2 if not row["n"] else int(row["bad"] > 0)


def by_level(results: DataFrame, *by: str, value: Column | None = None) -> DataFrame:
    """One row per ``by`` with the columns a, b and c: the mean of ``value`` (0/1 correctness by default) over parsed answers."""
    value = F.col("correct").cast("int") if value is None else value
    return results.groupBy(*by).pivot("level", ["a", "b", "c"]).agg(F.avg(value))


def literacy_gap(results: DataFrame, *by: str) -> DataFrame:
    """(by..., acc_a, acc_b, acc_c, gap, controlled_gap): acc(a) - acc(c), and acc(b) - acc(c), which holds the narrator fixed."""
    levels = by_level(results, *by)
    return levels.select(*by, *[F.col(x).alias(f"acc_{x}") for x in "abc"], (F.col("a") - F.col("c")).alias("gap"), (F.col("b") - F.col("c")).alias("controlled_gap"))
