"""JSON Lines logs: scans that skip blank and malformed lines and say which, with file lineage; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.answers import strip


def _found(spark: SparkSession, path: str) -> list:
    """Hadoop paths of what the path or glob has."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [f.getPath() for f in found or []]


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what the path or glob has, empty files too, in order."""
    return sorted(f.getName() for f in _found(spark, path))


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(file_names(spark, path))


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def person_of(file_name: Column) -> Column:
    """Who logged a file: its name without the extension and without every ``api_calls_``."""
    return F.replace(F.regexp_replace(file_name, r"\.jsonl$", ""), F.lit("api_calls_"), F.lit(""))


def scan_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of one or more JSON Lines files as text splits: schema columns, file_name and malformed.

    A missing path gives an empty table.  Blank lines are left out; a line that is no JSON object gives a row of
    nulls with its text in ``malformed``.  Files are split and read in parallel; use ``numbered_log`` where
    the order of lines matters.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema).withColumns({"file_name": F.lit(None).cast("string"), "malformed": F.lit(None).cast("string")})
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_name").alias("file_name"))
    return parsed_lines(lines, schema).select(*schema.fieldNames(), "file_name", "malformed")


def numbered_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As ``scan_log``, with line_no: 1 for the first line of its log, blank lines counted.

    What the path or glob names is a log: a file, or a folder with the log's parts, by the number that Spark gave them or else by
    name; file_name is the log's own name.  Logs are read in splits: lines are numbered within their split, and the counts of the
    splits before it, a row each, are broadcast and added, so a log of any size is read by many tasks and not shuffled.
    """
    empty = {"file_name": F.lit(None).cast("string"), "line_no": F.lit(None).cast("long"), "malformed": F.lit(None).cast("string")}
    found = _found(spark, path)
    if not found:
        return spark.createDataFrame([], schema).withColumns(empty)
    depths = {p.depth() for p in found}
    if len(depths) > 1:
        raise ValueError(f"logs at different depths: {path}")
    level = depths.pop() + 1
    read = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = read.withColumn("place", F.monotonically_increasing_id())
    names = F.split(F.regexp_replace("file", "^[^:/]+:(//[^/]*)?", ""), "/")
    log = {"log": F.array_join(F.slice(names, 1, level), "/"), "file_name": F.url_decode(F.replace(F.get(names, F.lit(level - 1)), F.lit("+"), F.lit("%2B")))}
    part = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.partitionBy("log").orderBy(part, "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).withColumns(log).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    here = F.col("place") - F.col("first")
    # Both scans have to cut the files alike, which a change in the number of executors between them could prevent.
    line_no = F.when((here >= 0) & (here < F.col("n")), here + F.col("before") + 1).otherwise(F.raise_error(F.lit("the logs were split anew while they were numbered")).cast("long"))
    numbered = lines.join(F.broadcast(splits), ["file", "block"], "left").select("value", "file_name", line_no.alias("line_no"))
    return parsed_lines(numbered, schema).select(*schema.fieldNames(), "file_name", "line_no", "malformed")


def parsed_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    """Rows (value, ...) parsed as JSON objects: blank ones left out, the text of others in ``malformed``."""
    full = StructType(list(schema.fields)).add("_corrupt", "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
    text = strip(F.col("value"))
    kept = lines.where(F.length(text) > 0).withColumn("row", F.from_json(text, full, options))
    object_like = text.startswith("{") & text.endswith("}")
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | ~object_like
    fields = {f.name: F.when(~bad, F.col(f"row.{f.name}")) for f in schema.fields}
    return kept.withColumns({**fields, "malformed": F.when(bad, F.col("value"))})


def rows_of(log: DataFrame) -> DataFrame:
    """The readable rows, without the scan's own columns."""
    return log.where("malformed is null").drop("malformed", "file_name", "line_no")


def malformed_lines(log: DataFrame) -> DataFrame:
    """What the scan skipped: (file_name, line_no where known, malformed)."""
    keep = [c for c in ("file_name", "line_no", "malformed") if c in log.columns]
    return log.where("malformed is not null").select(*keep)


def key_scan(spark: SparkSession, path: str, key: tuple[str, ...], schema: StructType) -> DataFrame:
    """The distinct keys a results log has; only the key's fields are parsed."""
    narrow = StructType([f for f in schema.fields if f.name in key])
    return rows_of(scan_log(spark, path, narrow)).select(*key).distinct()


def append_log(df: DataFrame, path: str) -> None:
    """Appends JSON lines; null fields are written as such."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def overwrite_log(df: DataFrame, path: str, order_by: list[Column] | None = None) -> None:
    """Replaces a log, a folder whose parts, one after the other, have the rows in the order of ``df`` or the given one."""
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
