"""Seeded samples whose members depend on the seed and the ids only, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _draw(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")).cast("binary"))


def sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows without replacement (all, if there are fewer): the smallest MD5s of seed and id.  Spark keeps the n smallest of each
    partition and merges them, so nothing is sorted as a whole."""
    return df.withColumn("__draw", _draw(seed, id_col)).orderBy("__draw", id_col).limit(n).drop("__draw")


def stratified_sample(df: DataFrame, n: int, seed: int, id_col: str, stratum: str) -> DataFrame:
    """n rows of each stratum (all, where there are fewer)."""
    by = Window.partitionBy(stratum).orderBy("__draw", id_col)
    return df.withColumn("__draw", _draw(seed, id_col)).withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= n).drop("__draw", "__rank")
