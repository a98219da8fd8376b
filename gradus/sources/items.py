"""Item sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rendering import bucket
from ..schemas import ITEMS, LETTERS
from .logs import rows_of, scan_log


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON Lines file of items."""
    return rows_of(scan_log(spark, path, ITEMS))


def from_questions(questions: DataFrame, *, question: str = "question", answer: str = "answer_idx", item_id: str = "item_id", options: str = "options") -> DataFrame:
    """Original (level a) items from a question table."""
    return questions.select(F.col(item_id).cast("string").alias("item_id"), F.col(question).alias("stem"), F.col(options).alias("options"), F.col(answer).alias("gold"), F.lit("a").alias("level"))


def mock_items(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n synthetic items whose gold letters depend on the seed."""
    ids = spark.range(n)
    gold = F.get(F.array(*[F.lit(x) for x in LETTERS]), bucket(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")), len(LETTERS)))
    texts = [x for k in LETTERS for x in (F.lit(k), F.lit(f"opt {k}"))]
    return ids.select(
        F.format_string("sanity_mock_%04d", "id").alias("item_id"),
        F.format_string("Synthetic sanity-check stem #%d.", "id").alias("stem"),
        F.create_map(*texts).alias("options"),
        gold.alias("gold"),
        F.lit("a").alias("level"),
    )


def rewritten_items(items: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Level b and c items from a rewriter's raw JSON (item_id, raw): the stem changes, options and gold stay."""
    from ..functions.text import rewrite_levels

    parsed = rewrites.select("item_id", rewrite_levels(F.col("raw")).alias("r"))
    long = parsed.selectExpr("item_id", "stack(2, 'b', r.level_b, 'c', r.level_c) as (level, stem)").where("stem is not null")
    return items.select("item_id", "options", "gold").join(long, "item_id").select("item_id", "stem", "options", "gold", "level")
