"""Evaluation tables derived from the driver's tables, by rules that DuckDB can repeat (SQL_* beside each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.rendering import bucket

MODELS = ("m-large", "m-small", "m-open")
RATES = (("m-large", 3.0, 12.0), ("m-small", 0.0, 0.0), ("m-open", None, 1.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letter(index: Column) -> Column:
    return F.substring(F.lit("ABCD"), index + 1, 1) if isinstance(index, int) else F.substr(F.lit("ABCD"), index + 1, F.lit(1))


def sql_bucket(key: str, n: int) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {n})"


def key(*parts) -> Column:
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as items at three levels; every item has two to four options, some no gold."""
    base = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("n"), "text")
    name = F.concat(F.lit("item_"), F.col("n"))
    letters = F.slice(F.array(*[F.lit(k) for k in schemas.LETTERS]), F.lit(1), bucket(key("options", name), 3) + 2)
    texts = F.transform(letters, lambda k: F.concat(F.lit("choice "), k, F.lit(" of "), F.col("n")))
    some = F.map_from_arrays(F.reverse(letters), F.reverse(texts))
    gold = F.when(bucket(key("void", name), 11) > 0, letter(bucket(key("gold", name), 4)))
    return base.select(name.alias("item_id"), F.col("text").alias("stem"), some.alias("options"), gold.alias("gold"), F.explode(F.array(*[F.lit(x) for x in schemas.LEVELS])).alias("level"))


SQL_ITEMS = f"""items AS (
  SELECT 'item_' || b.item_id AS item_id, b.text AS stem, b.item_id AS n, {sql_bucket("'options|item_' || b.item_id", 3)} + 2 AS options,
         CASE WHEN {sql_bucket("'void|item_' || b.item_id", 11)} > 0 THEN substr('ABCD', ({sql_bucket("'gold|item_' || b.item_id", 4)} + 1)::BIGINT, 1) END AS gold, l.level
  FROM benchmark b, (VALUES ('a'), ('b'), ('c')) l(level)
)"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, model, level, prompt_condition, gold, raw_output): every document as an item at three levels on three models, answered by
    templates; null levels stand for items without one."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("item_id"))
    work = docs.withColumn("level", F.explode(F.array(*[F.lit(x) for x in schemas.LEVELS]))).withColumn("model", F.explode(F.array(*[F.lit(x) for x in MODELS])))
    here = key(F.col("item_id"), F.col("level"), F.col("model"))
    good = bucket(key(here, "hit"), 10) < F.when(F.col("level") == "a", 8).when(F.col("level") == "b", 7).otherwise(5)
    gold = bucket(key("gold", F.col("item_id")), 4)
    said = letter(F.when(good, gold).otherwise((gold + 1) % 4))
    form = bucket(key(here, "form"), 8)
    raw = (
        F.when(form == 0, said).when(form == 1, F.concat(F.lit("Answer: "), said)).when(form == 2, F.concat(F.lit("("), said, F.lit(")"))).when(form == 3, F.concat(F.lit("**"), said, F.lit("**")))
        .when(form == 4, "A or B").when(form == 5, "no idea, sorry").when(form == 6, F.concat(F.lit("The right one is "), said, F.lit(".\n"))).otherwise(F.concat(F.lit(" "), F.lower(said), F.lit("... ")))
    )
    return work.select("item_id", "model", "level", F.lit("plain").alias("prompt_condition"), letter(gold).alias("gold"), raw.alias("raw_output"))


_HERE = "d.item_id || '|' || l.level || '|' || m.model"
SQL_OUTPUTS = f"""outputs AS (
  SELECT item_id, level, model, 'plain' AS prompt_condition, substr('ABCD', (gold + 1)::BIGINT, 1) AS gold, form,
         CASE WHEN form IN (4, 5) THEN NULL ELSE substr('ABCD', (CASE WHEN good THEN gold ELSE (gold + 1) % 4 END + 1)::BIGINT, 1) END AS predicted
  FROM (
    SELECT d.item_id, l.level, m.model, {sql_bucket("'gold|' || d.item_id", 4)} AS gold, {sql_bucket(_HERE + " || '|form'", 8)} AS form,
           {sql_bucket(_HERE + " || '|hit'", 10)} < CASE l.level WHEN 'a' THEN 8 WHEN 'b' THEN 7 ELSE 5 END AS good
    FROM (SELECT 'doc_' || doc_id AS item_id FROM documents) d, (VALUES ('a'), ('b'), ('c')) l(level), (VALUES ('m-large'), ('m-small'), ('m-open')) m(model)
  )
)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.answers import is_correct, parse_answer

    return outputs(spark, sf_dir).withColumn("predicted", parse_answer(F.col("raw_output"))).withColumn("correct", is_correct(F.col("predicted"), F.col("gold")))


SQL_RESULTS = SQL_OUTPUTS + ", results AS (SELECT *, predicted = gold AS correct FROM outputs)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged calls; one model has no complete rate."""
    e = table(spark, sf_dir, "events")
    stage = F.col("event_type")
    for a, b in (("view", "eval"), ("signup", "rewrite"), ("error", "verify"), ("click", "pilot"), ("purchase", "intervention")):
        stage = F.when(F.col("event_type") == a, b).otherwise(stage)
    model = F.get(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % 3).cast("int"))
    level = F.when(F.col("event_id") % 7 != 0, F.get(F.array(*[F.lit(x) for x in schemas.LEVELS]), (F.col("event_id") % 3).cast("int")))
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), stage.alias("stage"), model.alias("model"), (F.col("event_id") % 977 + 50).alias("input_tokens"),
        (F.col("event_id") % 13 + 1).alias("output_tokens"), F.concat(F.lit("item_"), (F.col("event_id") % 500).cast("string")).alias("item_id"), level.alias("level"), F.lit("plain").alias("prompt_condition"),
    )


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.pricing import price

    return price(calls(spark, sf_dir), spark.createDataFrame(list(RATES), schemas.RATES))


SQL_CALLS = """calls AS (
  SELECT *, input_tokens / 1000000.0::DOUBLE * rin + output_tokens / 1000000.0::DOUBLE * rout AS cost_usd FROM (
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
           CASE event_type WHEN 'view' THEN 'eval' WHEN 'signup' THEN 'rewrite' WHEN 'error' THEN 'verify' WHEN 'click' THEN 'pilot' WHEN 'purchase' THEN 'intervention' ELSE event_type END AS stage,
           CASE user_id % 3 WHEN 0 THEN 'm-large' WHEN 1 THEN 'm-small' ELSE 'm-open' END AS model,
           event_id % 977 + 50 AS input_tokens, event_id % 13 + 1 AS output_tokens, 'item_' || (event_id % 500) AS item_id,
           CASE WHEN event_id % 7 <> 0 THEN substr('abc', (event_id % 3 + 1)::BIGINT, 1) END AS level, 'plain' AS prompt_condition
    FROM events
  ) LEFT JOIN (VALUES ('m-large', 3.0::DOUBLE, 12.0::DOUBLE), ('m-small', 0.0::DOUBLE, 0.0::DOUBLE), ('m-open', NULL::DOUBLE, 1.0::DOUBLE)) r(model, rin, rout) USING (model)
)"""


def shared_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two people's overlapping logs, with file_name and line_no; every fiftieth call stands twice in the first one."""
    c = priced(spark, sf_dir)
    part = F.col("event_id") % 10
    ana = c.where(part < 6).withColumns({"file_name": F.lit("api_calls_ana.jsonl"), "line_no": F.col("event_id")})
    twice = c.where((part < 6) & (F.col("event_id") % 50 == 0)).withColumns({"file_name": F.lit("api_calls_ana.jsonl"), "line_no": F.col("event_id") + 10_000_000})
    bo = c.where(part >= 3).withColumns({"file_name": F.lit("api_calls_bo.jsonl"), "line_no": F.col("event_id")})
    return ana.union(twice).union(bo)


SQL_SHARED = SQL_CALLS + """, shared AS (
  SELECT *, 'ana' AS person, event_id AS line_no FROM calls WHERE event_id % 10 < 6
  UNION ALL SELECT *, 'ana', event_id + 10000000 FROM calls WHERE event_id % 10 < 6 AND event_id % 50 = 0
  UNION ALL SELECT *, 'bo', event_id FROM calls WHERE event_id % 10 >= 3
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY ts, stage, model, input_tokens, output_tokens, item_id ORDER BY person, line_no) = 1 AS kept FROM shared
)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the session's shared one, or in a temporary one where that is unset (a single local JVM, as in tests)."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gradus-")
    return f"{root.rstrip('/')}/gradus-{name}-{uuid.uuid4().hex}"


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the shared logs as JSON lines, in order, with a blank and a malformed line each, as folders of ordered parts, and
    an empty log, a file."""
    folder = scratch(spark, "logs")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    shared = shared_logs(spark, sf_dir)
    odd = spark.createDataFrame([(-2, "  "), (-1, "{broken")], "line_no long, value string")
    for person in ("ana", "bo"):
        rows = shared.where(F.col("file_name") == f"api_calls_{person}.jsonl").select("line_no", F.to_json(F.struct(*[c for c in shared.columns if c not in ("file_name", "line_no")])).alias("value"))
        rows.union(odd).orderBy("line_no").select("value").write.text(f"{folder}/api_calls_{person}.jsonl")
    fs.create(path(f"{folder}/api_calls_cy.jsonl")).close()
    return folder
