"""One query per operator of the evaluation engine over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rendering, text
from .. import schemas
from ..operators import costs, evaluation, merging, rules, sampling, scoring, statistics
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TEMPLATE = "Read {stem} first.\nThen choose:\n{options}\nAnswer with a letter, {\"not\": json}."


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"""WITH {fx.SQL_RESULTS}
SELECT model, level, count(*) AS n, count(predicted) AS scored, count(*) FILTER (correct) AS correct,
  round(coalesce(count(*) FILTER (correct)::DOUBLE / nullif(count(predicted), 0), 0), 6) AS accuracy, count(*) FILTER (predicted IS NULL) AS unparseable,
  round(count(*) FILTER (predicted IS NULL)::DOUBLE / count(*), 6) AS parse_fail_rate
FROM results GROUP BY model, level""")
def accuracy_by_model_level(spark, sf_dir):
    return rounded(scoring.accuracy(fx.results(spark, sf_dir), "model", "level"), "accuracy", "parse_fail_rate")


@query(f"WITH {fx.SQL_RESULTS} SELECT item_id, model, level, predicted, gold, correct FROM results")
def parse_and_score(spark, sf_dir):
    return fx.results(spark, sf_dir).select("item_id", "model", "level", "predicted", "gold", "correct")


@query(f"WITH {fx.SQL_RESULTS} SELECT item_id, model, level, prompt_condition FROM results WHERE predicted IS NULL")
def parse_failures(spark, sf_dir):
    return evaluation.failures_of(fx.results(spark, sf_dir)).select("item_id", "model", "level", "prompt_condition")


_SQL_PROMPT = f"""WITH {fx.SQL_ITEMS}, prompts AS (
  SELECT item_id, level, 'Read ' || stem || ' first.' || chr(10) || 'Then choose:' || chr(10) || 'A. choice A of ' || n || chr(10) || 'B. choice B of ' || n
    || CASE WHEN options >= 3 THEN chr(10) || 'C. choice C of ' || n ELSE '' END || CASE WHEN options >= 4 THEN chr(10) || 'D. choice D of ' || n ELSE '' END
    || chr(10) || 'Answer with a letter, {{"not": json}}.' AS prompt FROM items
)"""


@query(_SQL_PROMPT + " SELECT item_id, level, prompt, substr(sha256(prompt), 1, 12) AS prompt_hash, greatest(1, length(prompt) // 4) AS tokens FROM prompts")
def render_prompts(spark, sf_dir):
    prompts = fx.items(spark, sf_dir).withColumn("prompt", rendering.render_prompt(TEMPLATE, F.col("stem"), F.col("options")))
    return prompts.select("item_id", "level", "prompt", rendering.prompt_hash(F.col("prompt")).alias("prompt_hash"), rendering.mock_tokens(F.col("prompt")).alias("tokens"))


@query(f"WITH {fx.SQL_ITEMS} SELECT item_id, level, substr('ABCD', ({fx.sql_bucket("item_id || '|' || 'm1' || '|plain'", 4)} + 1)::BIGINT, 1) AS answer FROM items")
def mock_answers(spark, sf_dir):
    return fx.items(spark, sf_dir).select("item_id", "level", rendering.mock_answer(F.col("item_id"), F.lit("m1"), F.lit("plain")).alias("answer"))


@query(f"WITH {fx.SQL_ITEMS} SELECT item_id, level, 'no gold answer' AS problem FROM items WHERE gold IS NULL")
def malformed_items(spark, sf_dir):
    items = fx.items(spark, sf_dir)
    bad = evaluation.malformed_items(items).distinct()
    return items.join(bad, "item_id").select("item_id", "level", "problem")


@query(f"""WITH {fx.SQL_ITEMS}, models(model, o) AS (VALUES ('one', 1), ('two', 2))
SELECT item_id, level, model, 'plain' AS prompt_condition FROM items, models""")
def requests_of_models(spark, sf_dir):
    models = [{"id": m, "name": m, "provider": "p", "temperature": 0, "max_tokens": 16, "seed": None} for m in ("one", "two")]
    return evaluation.requests(fx.items(spark, sf_dir), models, TEMPLATE, "plain").select("item_id", "level", "model", "prompt_condition")


@query(f"""WITH {fx.SQL_ITEMS}, conditions(condition) AS (VALUES ('plain'), ('clarify_first'))
SELECT item_id, level, condition FROM items, conditions WHERE condition <> 'clarify_first' OR level = 'c'""")
def prompt_conditions(spark, sf_dir):
    scoped = evaluation.in_scope(fx.items(spark, sf_dir), ["plain", "clarify_first"])
    return scoped.select("item_id", "level", F.col("prompt_condition").alias("condition"))


@query(f"""WITH {fx.SQL_CALLS}, done AS (SELECT DISTINCT item_id, model, level, prompt_condition FROM calls WHERE event_id % 4 = 0)
SELECT event_id, c.item_id, c.model, c.level FROM calls c WHERE NOT EXISTS (
  SELECT 1 FROM done d WHERE d.item_id IS NOT DISTINCT FROM c.item_id AND d.model IS NOT DISTINCT FROM c.model AND d.level IS NOT DISTINCT FROM c.level AND d.prompt_condition IS NOT DISTINCT FROM c.prompt_condition)""")
def resume_pending(spark, sf_dir):
    calls = fx.calls(spark, sf_dir)
    return evaluation.unfinished(calls, calls.where("event_id % 4 = 0")).select("event_id", "item_id", "model", "level")


@query(f"""WITH {fx.SQL_CALLS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, model, level, prompt_condition ORDER BY event_id) > 1 AS again FROM calls)
SELECT CASE WHEN again THEN 'skipped' ELSE 'run' END AS status, count(*) AS n FROM ranked GROUP BY 1""")
def batch_status_counts(spark, sf_dir):
    marked = evaluation.first_of_key(fx.calls(spark, sf_dir).withColumn("position", F.col("event_id")))
    return marked.groupBy(F.when(F.col("repeated"), "skipped").otherwise("run").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.SQL_CALLS} SELECT event_id, model, round(cost_usd, 9) AS cost_usd FROM calls")
def price_calls(spark, sf_dir):
    return fx.priced(spark, sf_dir).select("event_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


_SQL_MEASURES = "count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(coalesce(sum(cost_usd), 0), 6) AS usd, count(*) FILTER (cost_usd IS NULL) AS unpriced"


@query(f"""WITH {fx.SQL_CALLS} SELECT 'stage' AS scope, stage AS name, {_SQL_MEASURES} FROM calls GROUP BY stage
UNION ALL SELECT 'model', model, {_SQL_MEASURES} FROM calls GROUP BY model UNION ALL SELECT 'total', NULL, {_SQL_MEASURES} FROM calls""")
def cost_summary(spark, sf_dir):
    return rounded(costs.summarize(costs.check_stages(fx.priced(spark, sf_dir))), "usd")


@query(f"WITH {fx.SQL_CALLS} SELECT count(*) AS total_calls, round(coalesce(sum(cost_usd), 0), 6) AS total_usd, count(*) FILTER (cost_usd IS NULL) AS unpriced, round(coalesce(sum(cost_usd), 0) * 12.73, 6) AS projected_usd FROM calls")
def cost_projection(spark, sf_dir):
    return rounded(costs.project(fx.priced(spark, sf_dir), 12.73), "total_usd", "projected_usd")


@query(f"""WITH {fx.SQL_CALLS}, rates(model, input, output) AS (VALUES ('m-large', 1.0, 2.0), ('m-small', NULL, 2.0))
SELECT DISTINCT c.model, CASE WHEN r.model IS NULL THEN 'rate' ELSE 'input' END AS lacks FROM calls c LEFT JOIN rates r ON c.model = r.model WHERE r.input IS NULL OR r.output IS NULL""")
def models_without_rate(spark, sf_dir):
    rates = spark.createDataFrame([("m-large", 1.0, 2.0), ("m-small", None, 2.0), ("unused", None, None)], schemas.RATES)
    return costs.without_rate(fx.calls(spark, sf_dir), rates)


@query(f"WITH {fx.SQL_SHARED} SELECT event_id, person AS _logged_by, ts, stage, model, item_id FROM marked WHERE kept")
def merge_keep_first(spark, sf_dir):
    return merging.merged(merging.mark_first(fx.shared_logs(spark, sf_dir))).select("event_id", "_logged_by", "ts", "stage", "model", "item_id")


@query(f"""WITH {fx.SQL_SHARED} SELECT person, count(*) FILTER (kept) AS calls, round(coalesce(sum(cost_usd) FILTER (kept), 0), 6) AS usd,
count(*) FILTER (kept AND cost_usd IS NULL) AS unpriced, count(*) FILTER (NOT kept) AS duplicates FROM marked GROUP BY person""")
def merge_by_person(spark, sf_dir):
    return rounded(merging.by_person(merging.mark_first(fx.shared_logs(spark, sf_dir))), "usd")


@query(f"""WITH {fx.SQL_SHARED} SELECT stage, count(*) AS calls, round(coalesce(sum(cost_usd), 0), 6) AS usd, count(*) FILTER (cost_usd IS NULL) AS unpriced
FROM marked WHERE kept GROUP BY GROUPING SETS ((stage), ())""")
def merge_by_stage(spark, sf_dir):
    return rounded(merging.by_stage(merging.mark_first(fx.shared_logs(spark, sf_dir))), "usd")


@query(f"""WITH {fx.SQL_RESULTS}, attempts AS (
  SELECT model AS model_id, predicted, correct, {fx.sql_bucket("item_id || model || level", 40)} = 0 AS failed FROM results
), s AS (
  SELECT model_id, count(*) AS n, count(*) FILTER (failed) AS errored,
    count(*) FILTER (NOT failed AND correct)::DOUBLE / count(*) FILTER (NOT failed AND predicted IS NOT NULL) AS accuracy,
    count(*) FILTER (NOT failed AND predicted IS NULL)::DOUBLE / count(*) FILTER (NOT failed) AS parse_fail_rate, count(*) FILTER (failed)::DOUBLE / count(*) AS error_rate
  FROM attempts GROUP BY model_id
), t(model_id, min_acc, max_acc, point) AS (VALUES ('m-large', 0.5::DOUBLE, 0.8::DOUBLE, 0.66::DOUBLE), ('m-small', 0.0::DOUBLE, 1.0::DOUBLE, NULL::DOUBLE))
SELECT model_id, n, errored, round(accuracy, 6) AS accuracy, round(parse_fail_rate, 6) AS parse_fail_rate, round(error_rate, 6) AS error_rate,
  CASE WHEN t.min_acc IS NULL THEN 'CHECK' WHEN point IS NULL THEN CASE WHEN parse_fail_rate <= 0.3 AND error_rate <= 0.3 THEN 'N/A' ELSE 'CHECK' END
       WHEN accuracy BETWEEN min_acc AND max_acc AND parse_fail_rate <= 0.3 AND error_rate <= 0.3 THEN 'PASS' ELSE 'CHECK' END AS verdict
FROM s LEFT JOIN t USING (model_id)""")
def sanity_verdicts(spark, sf_dir):
    r = fx.results(spark, sf_dir)
    status = F.when(rendering.bucket(F.concat("item_id", "model", "level"), 40) == 0, "failed").otherwise("run")
    attempts = r.select(F.col("model").alias("model_id"), status.alias("status"), "predicted", "correct")
    targets = spark.createDataFrame([("m-large", 0.5, 0.8, 0.66, ""), ("m-small", 0.0, 1.0, None, "")], "model_id string, min_acc double, max_acc double, point double, note string")
    judged = scoring.verdicts(scoring.sanity_summary(attempts), targets, 0.3)
    return rounded(judged, "accuracy", "parse_fail_rate", "error_rate").drop("min_acc", "max_acc", "point")


@query(f"""WITH {fx.SQL_RESULTS}, l AS (SELECT model, avg(correct::INT) FILTER (level = 'a') AS a, avg(correct::INT) FILTER (level = 'b') AS b, avg(correct::INT) FILTER (level = 'c') AS c FROM results GROUP BY model)
SELECT model, round(a, 6) AS acc_a, round(b, 6) AS acc_b, round(c, 6) AS acc_c, round(a - c, 6) AS gap, round(b - c, 6) AS controlled_gap FROM l""")
def literacy_gap(spark, sf_dir):
    return rounded(scoring.literacy_gap(fx.results(spark, sf_dir), "model"), "acc_a", "acc_b", "acc_c", "gap", "controlled_gap")


@query(f"""WITH {fx.SQL_RESULTS}, p AS (
  SELECT a.model, a.correct AS x, c.correct AS y FROM results a JOIN results c USING (item_id, model, prompt_condition) WHERE a.level = 'a' AND c.level = 'c' AND a.correct IS NOT NULL AND c.correct IS NOT NULL
), k AS (SELECT model, count(*) AS n, count(*) FILTER (x AND NOT y) AS only_first, count(*) FILTER (NOT x AND y) AS only_second FROM p GROUP BY model)
SELECT *, round(CASE WHEN only_first + only_second > 0 THEN greatest(0, abs(only_first - only_second) - 1)::DOUBLE ** 2 / (only_first + only_second) END, 6) AS statistic FROM k""")
def mcnemar_levels(spark, sf_dir):
    return rounded(statistics.mcnemar(statistics.paired(fx.results(spark, sf_dir)), "model"), "statistic")


@query("""WITH c AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2),
t AS (SELECT sum(n)::DOUBLE AS n, sum(n) FILTER (x = y)::DOUBLE AS agree FROM c),
e AS (SELECT sum(p * q)::DOUBLE AS chance FROM (SELECT x AS label, sum(n) AS p FROM c GROUP BY 1) JOIN (SELECT y AS label, sum(n) AS q FROM c GROUP BY 1) USING (label))
SELECT t.n::BIGINT AS n, round((agree * t.n - chance) / (t.n * t.n - chance), 6) AS kappa FROM t, e""")
def rater_kappa(spark, sf_dir):
    return rounded(statistics.cohen_kappa(fx.table(spark, sf_dir, "labels"), "quality", "toxic"), "kappa")


@query("SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS rater_accuracy, avg((quality = toxic)::INT) <= 0.75 AS passes FROM labels")
def rater_gate(spark, sf_dir):
    return rounded(statistics.rater_gate(fx.table(spark, sf_dir, "labels").select(F.col("quality").alias("guess"), F.col("toxic").alias("truth"))), "rater_accuracy")


_SQL_FK = r"""f AS (
  SELECT doc_id, source, len(regexp_extract_all(lower(text), '\p{L}+')) AS w, greatest(1, len(regexp_extract_all(lower(text), '[.!?]+'))) AS s, len(regexp_extract_all(lower(text), '[aeiouyáéíóúàèìòùâêîôûäëïöü]+')) AS v FROM documents
), g AS (SELECT doc_id, source, CASE WHEN w > 0 THEN 0.39::DOUBLE * w / s + 11.8::DOUBLE * greatest(w, v) / w - 15.59::DOUBLE END AS fk FROM f)"""


@query(f"WITH {_SQL_FK} SELECT doc_id, round(fk, 4) AS fk FROM g")
def readability(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.round(text.fk_grade(F.col("text")), 4).alias("fk"))


@query(f"WITH {_SQL_FK} SELECT source, round(quantile_cont(fk, 0.5), 4) AS median FROM g GROUP BY source")
def median_readability(spark, sf_dir):
    graded = fx.table(spark, sf_dir, "documents").select("source", text.fk_grade(F.col("text")).alias("fk"))
    return statistics.median(graded, "fk", "source").withColumn("median", F.round("median", 4))


@query(f"""WITH {_SQL_FK}, m AS (SELECT quantile_cont(fk, 0.5) FILTER (source = 'src1') AS l, quantile_cont(fk, 0.5) FILTER (source = 'src2') AS r FROM g)
SELECT round(l, 4) AS left_median, round(r, 4) AS right_median, round(l - r, 4) AS delta, abs(l - r) <= 2.0 AS passes FROM m""")
def readability_gate(spark, sf_dir):
    graded = fx.table(spark, sf_dir, "documents").select("source", text.fk_grade(F.col("text")).alias("fk"))
    gate = statistics.shift_gate(graded.where("source = 'src1'"), graded.where("source = 'src2'"), "fk", most=2.0)
    return gate.withColumns({n: F.round(n, 4) for n in ("left_median", "right_median", "delta")})


_SQL_ATTEMPTS = f"attempts AS (SELECT d.doc_id AS item_id, a AS attempt, {fx.sql_bucket("d.doc_id || '|' || a", 3)} = 0 AS passed FROM documents d, range(1, 6) r(a))"


def _attempts(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(5)).cast("array<bigint>")))
    return docs.withColumn("passed", rendering.bucket(fx.key(F.col("item_id").cast("string"), F.col("attempt").cast("string")), 3) == 0)


@query(f"""WITH {_SQL_ATTEMPTS}, i AS (SELECT item_id, bool_or(passed) AS ok FROM attempts WHERE attempt <= 3 GROUP BY item_id)
SELECT count(*) AS items, count(*) FILTER (NOT ok) AS dropped, round(avg((NOT ok)::INT), 6) AS drop_rate FROM i""")
def drop_rate(spark, sf_dir):
    return rounded(statistics.drop_rate(_attempts(spark, sf_dir)), "drop_rate")


@query(f"""WITH {_SQL_ATTEMPTS} SELECT item_id, coalesce(min(attempt) FILTER (passed), max(attempt)) AS attempt, bool_or(passed) AS passed FROM attempts WHERE attempt <= 3 GROUP BY item_id""")
def regeneration_attempts(spark, sf_dir):
    return statistics.last_attempts(_attempts(spark, sf_dir))


@query("SELECT doc_id FROM documents ORDER BY md5('17|' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return sampling.sample(fx.table(spark, sf_dir, "documents").select("doc_id"), 50, 17, "doc_id")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('17|' || doc_id), doc_id) <= 5")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(fx.table(spark, sf_dir, "documents").select("doc_id", "source"), 5, 17, "doc_id", "source")


@query(r"""WITH r AS (SELECT event_id, 'dose ' || event_id || ' then ' || (event_id % 100) || '.5 and ' || (event_id % 7) AS o, 'take ' || (event_id % 100) || '.5 and ' || (event_id % 5) AS w FROM events)
SELECT event_id, coalesce(array_to_string(list_filter(list_distinct(regexp_extract_all(o, '\d+(?:\.\d+)?')), lambda x: NOT list_contains(regexp_extract_all(w, '\d+(?:\.\d+)?'), x)).list_sort(), ','), '') AS lost FROM r""")
def lost_numbers(spark, sf_dir):
    e, s = fx.table(spark, sf_dir, "events"), lambda n: (F.col("event_id") % n).cast("string")
    original = F.concat(F.lit("dose "), F.col("event_id").cast("string"), F.lit(" then "), s(100), F.lit(".5 and "), s(7))
    rewrite = F.concat(F.lit("take "), s(100), F.lit(".5 and "), s(5))
    return e.select("event_id", F.array_join(F.array_sort(text.lost_numbers(original, rewrite)), ",").alias("lost"))


@query("""SELECT 'item_' || item_id AS item_id, level, CASE level WHEN 'b' THEN 'plain ' ELSE 'low ' END || item_id AS stem FROM benchmark, (VALUES ('b'), ('c')) l(level) WHERE item_id % 5 <> 0""")
def rewritten_items(spark, sf_dir):
    from ..sources.items import rewritten_items as rewritten

    items = fx.items(spark, sf_dir).where("level = 'a'")
    n = F.substring_index("item_id", "_", -1)
    raw = F.when(n.cast("long") % 5 == 0, F.concat(F.lit("{broken "), n)).otherwise(F.to_json(F.struct(F.concat(F.lit("plain "), n).alias("level_b"), F.concat(F.lit("low "), n).alias("level_c"))))
    return rewritten(items, items.select("item_id", raw.alias("raw"))).select("item_id", "level", "stem")


@query("""SELECT format('sanity_mock_{:04d}', i) AS item_id, 'Synthetic sanity-check stem #' || i || '.' AS stem, """ + f"""substr('ABCD', ({fx.sql_bucket("'20260807|' || i", 4)} + 1)::BIGINT, 1) AS gold, 'a' AS level FROM range(200) r(i)""")
def mock_items(spark, sf_dir):
    from ..sources.items import mock_items as made

    return made(spark, 200, 20260807).drop("options")


@query("SELECT 'q' || item_id AS item_id, text AS stem, 'B' AS gold, 'a' AS level FROM benchmark")
def question_items(spark, sf_dir):
    from ..sources.items import from_questions

    q = fx.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("item_id"), F.col("text").alias("question"), F.lit("B").alias("answer_idx"), F.create_map(F.lit("A"), F.lit("x")).alias("options"))
    return from_questions(q).drop("options")


def _log_lines(spark, sf_dir):
    """Calls as lines of two logs; some are blank, some malformed."""
    calls = fx.calls(spark, sf_dir)
    line = F.to_json(F.struct("ts", "stage", "model", "input_tokens", "output_tokens", "item_id", "level"))
    value = F.when(F.col("event_id") % 20 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).when(F.col("event_id") % 21 == 0, "  ").otherwise(line)
    name = F.when(F.col("event_id") % 2 == 0, "api_calls_ana.jsonl").otherwise("api_calls_bo_api_calls_2.jsonl")
    return calls.select(value.alias("value"), name.alias("file_name"))


@query(f"""WITH {fx.SQL_CALLS} SELECT CASE WHEN event_id % 2 = 0 THEN 'ana' ELSE 'bo_2' END AS person, ts, stage, model, input_tokens, output_tokens, item_id, level
FROM calls WHERE event_id % 20 <> 0 AND event_id % 21 <> 0""")
def scan_log_lines(spark, sf_dir):
    from ..schemas import CALLS
    from ..sources.logs import parsed_lines, person_of

    rows = parsed_lines(_log_lines(spark, sf_dir), CALLS).where("malformed is null")
    return rows.select(person_of(F.col("file_name")).alias("person"), "ts", "stage", "model", "input_tokens", "output_tokens", "item_id", "level")


@query(f"WITH {fx.SQL_CALLS} SELECT CASE WHEN event_id % 2 = 0 THEN 'api_calls_ana.jsonl' ELSE 'api_calls_bo_api_calls_2.jsonl' END AS file_name, '{{broken ' || event_id AS malformed FROM calls WHERE event_id % 20 = 0")
def malformed_log_lines(spark, sf_dir):
    from ..schemas import CALLS
    from ..sources.logs import malformed_lines, parsed_lines

    return malformed_lines(parsed_lines(_log_lines(spark, sf_dir), CALLS))


@query(f"WITH {fx.SQL_CALLS} SELECT DISTINCT item_id, model, level FROM calls WHERE event_id % 20 <> 0 AND event_id % 21 <> 0")
def scan_log_keys(spark, sf_dir):
    from ..schemas import CALLS
    from ..sources.logs import parsed_lines

    return parsed_lines(_log_lines(spark, sf_dir), CALLS).where("malformed is null").select("item_id", "model", "level").distinct()


@query(f"""WITH {fx.SQL_RESULTS} SELECT item_id, model, level, prompt_condition, predicted, gold, correct, substr(sha256('a' || chr(10) || 'b'), 1, 12) AS prompt_hash, 3::INT AS config_version FROM results""")
def result_rows(spark, sf_dir):
    digest = spark.range(1).select(rendering.prompt_hash(F.lit("a\r\nb"))).first()[0]
    staged = fx.outputs(spark, sf_dir).withColumn("status", F.lit("run"))
    return evaluation.results_of(staged, digest, 3).drop("raw_output")


#: A configuration that breaks most rules.
_CONFIG = {
    "run": {"pilot_mode": True}, "dataset": {"n_items": None},
    "models": {
        "rewriter": {"name": "rw", "version": None, "temperature": 1}, "verifier": {"name": "rw", "version": None},
        "evaluated": [
            {"id": "open", "provider": "local", "name": None}, {"id": "one", "provider": "local", "name": "rw", "version": "1", "temperature": 0}, {"id": "two", "provider": "local", "name": "m2", "temperature": 0.5},
        ],
    },
    "generation": {"rewriter_prompt": "no/such/file"}, "prompt_conditions": [], "gates": {"realism": {"max_rater_accuracy": 0.9}, "fidelity": {"min_filter_human_kappa": 0.5}},
    "cost_rates_usd_per_1m": {"rw": {"input": 1.0}},
}


@query("""SELECT * FROM (VALUES ('V1', 'BLOCK', 'rewriter'), ('V2', 'BLOCK', 'rewriter'), ('V3', 'WARN', 'verifier'), ('V4', 'BLOCK', 'verifier'), ('V5', 'BLOCK', 'rw'), ('V6', 'WARN', 'rw'), ('V7', 'BLOCK', 'open'),
('V8', 'WARN', 'two'), ('V9', 'BLOCK', 'two'), ('V10', 'WARN', 'dataset'), ('V12', 'WARN', 'm2'), ('V13', 'WARN', 'rw'), ('V14', 'BLOCK', 'no/such/file'), ('V16', 'WARN', 'realism'), ('V17', 'WARN', 'fidelity')) t(rule, severity, subject)""")
def rule_findings(spark, sf_dir):
    from ..operators.rules import findings_table

    return findings_table(spark, _CONFIG).drop("message")


@query("""SELECT * FROM (VALUES ('two', 'ready'), ('one', 'ready'), ('open', 'its name is not chosen yet'), ('typo', 'it is not in the configuration')) t(model_id, state)""")
def model_selection(spark, sf_dir):
    chosen, left = evaluation.select_models(_CONFIG, ["two", "typo", "one", "open"])
    return spark.createDataFrame([(m["id"], "ready") for m in chosen] + left, "model_id string, state string")


@query("""SELECT DISTINCT level, missing FROM (SELECT level, CASE level WHEN 'a' THEN '' WHEN 'b' THEN '{options}' ELSE '{options},{stem}' END AS missing FROM (VALUES ('a'), ('b'), ('c')) l(level))""")
def missing_placeholders(spark, sf_dir):
    templates = spark.createDataFrame([("a", "{stem} {options}"), ("b", "{stem} {option}"), ("c", "none")], "level string, template string")
    return templates.select("level", F.array_join(rules.missing_placeholders(F.col("template")), ",").alias("missing"))


@query(f"""WITH {fx.SQL_SHARED} SELECT row_number() OVER (ORDER BY coalesce(ts, ''), person, line_no) AS line_no, ts, stage, model, item_id, level, person AS _logged_by FROM marked WHERE kept""")
def merge_log_files(spark, sf_dir):
    """Logs as files, merged, written as one ordered log, in parts, and read again."""
    from ..sources import logs

    calls, _, _ = merging.merge_logs(spark, fx.log_files(spark, sf_dir))
    out = fx.scratch(spark, "merged")
    logs.overwrite_log(calls, out)
    return logs.numbered_log(spark, out, schemas.CALLS_MERGED).select("line_no", "ts", "stage", "model", "item_id", "level", "_logged_by")


@query(f"""WITH {fx.SQL_SHARED} SELECT person, count(*) FILTER (kept) AS calls, round(coalesce(sum(cost_usd) FILTER (kept), 0), 6) AS usd,
count(*) FILTER (kept AND cost_usd IS NULL) AS unpriced, count(*) FILTER (NOT kept) AS duplicates FROM marked GROUP BY person UNION ALL SELECT 'cy', 0, 0, 0, 0""")
def log_files_by_person(spark, sf_dir):
    return rounded(merging.merge_logs(spark, fx.log_files(spark, sf_dir))[1], "usd")


@query("SELECT 'api_calls_' || person || '.jsonl' AS file_name, 2::BIGINT AS line_no, '{broken' AS malformed FROM (VALUES ('ana'), ('bo')) t(person)")
def malformed_lines_of_files(spark, sf_dir):
    from ..sources import logs

    return logs.malformed_lines(merging.read_shared_logs(spark, fx.log_files(spark, sf_dir)))


@query(f"""WITH {fx.SQL_RESULTS} SELECT 'results' AS log, item_id, model, level, prompt_condition FROM results UNION ALL SELECT 'parse_failures', item_id, model, level, prompt_condition FROM results WHERE predicted IS NULL""")
def appended_logs(spark, sf_dir):
    """Results and parse failures appended in two parts; the keys are read from the files."""
    from ..sources import logs

    staged, out = fx.outputs(spark, sf_dir).withColumn("status", F.lit("run")), fx.scratch(spark, "results")
    for part in (staged.where("level = 'a'"), staged.where("level <> 'a'")):
        found = evaluation.results_of(part, "0", 3)
        logs.append_log(found, f"{out}/results")
        logs.append_log(evaluation.failures_of(found), f"{out}/parse_failures")
    keys = {name: logs.key_scan(spark, f"{out}/{name}", schemas.RESULT_KEY, schema) for name, schema in (("results", schemas.RESULTS), ("parse_failures", schemas.PARSE_FAILURES))}
    results, failures = (df.select(F.lit(name).alias("log"), *schemas.RESULT_KEY) for name, df in keys.items())
    return results.union(failures)
