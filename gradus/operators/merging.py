"""Merging call logs of several people: the first record of each call counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..schemas import CALL_KEY, CALLS
from ..sources.logs import file_names, numbered_log, path_exists, person_of


def read_shared_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All ``api_calls_*.jsonl`` of the folder, numbered; FileNotFoundError if there are none."""
    pattern = f"{folder.rstrip('/')}/api_calls_*.jsonl"
    if not path_exists(spark, pattern):
        raise FileNotFoundError(f"no api_calls_*.jsonl in {folder}")
    return numbered_log(spark, pattern, CALLS)


def mark_first(log: DataFrame, key: tuple[str, ...] = CALL_KEY) -> DataFrame:
    """``log`` with ``kept``: true for the first row of its key by (file_name, line_no).  Null key fields equal each other.

    A window over the key keeps which row it was, which the credit per person needs; keys of a call are close to unique,
    so partitions are small.
    """
    by = Window.partitionBy(*key).orderBy("file_name", "line_no")
    return log.withColumn("kept", F.row_number().over(by) == 1)


def merged(marked: DataFrame) -> DataFrame:
    """The kept calls with _logged_by, in order of time as text, then of file and line."""
    out = marked.where("kept").withColumn("_logged_by", person_of(F.col("file_name")))
    return out.orderBy(F.coalesce("ts", F.lit("")), "file_name", "line_no").select(*[c for c in out.columns if c not in ("kept", "malformed", "file_name", "line_no")])


def by_person(marked: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(person, calls, usd, unpriced, duplicates), a row for everyone with a file: ``files`` (file_name) adds those whose file is empty."""
    kept = F.col("kept")
    grouped = marked.groupBy(person_of(F.col("file_name")).alias("person")).agg(
        F.count_if(kept).alias("calls"),
        F.coalesce(F.sum(F.when(kept, F.col("cost_usd"))), F.lit(0.0)).alias("usd"),
        F.count_if(kept & F.col("cost_usd").isNull()).alias("unpriced"),
        F.count_if(~kept).alias("duplicates"),
    )
    if files is None:
        return grouped
    people = files.select(person_of(F.col("file_name")).alias("person")).distinct()
    return people.join(grouped, "person", "left").fillna(0, ["calls", "usd", "unpriced", "duplicates"])


def by_stage(marked: DataFrame) -> DataFrame:
    """(stage, calls, usd, unpriced) of the kept calls, and a last row with stage NULL for the team."""
    kept = marked.where("kept")
    grouped = kept.groupingSets([[F.col("stage")], []], F.col("stage")).agg(
        F.grouping_id().alias("team"), F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced")
    )
    return grouped.select(F.when(F.col("team") == 0, F.col("stage")).alias("stage"), "calls", "usd", "unpriced")


def merge_logs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged calls, by person, by stage) of a shared folder."""
    pattern = f"{folder.rstrip('/')}/api_calls_*.jsonl"
    log = read_shared_logs(spark, folder)
    marked = mark_first(log.where("malformed is null").drop("malformed"))
    files = spark.createDataFrame([(n,) for n in file_names(spark, pattern)], "file_name string")
    return merged(marked), by_person(marked, files), by_stage(marked)
