"""Evaluating models on items: what is left to do, the calls, and the three logs they give."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import schemas
from ..functions.answers import is_correct, parse_answer
from ..functions.pricing import price
from ..functions.rendering import mock_answer, mock_tokens, render_prompt
from ..sources import config as cfg
from ..sources.logs import append_log, delete_path, file_names, key_scan, path_exists
from ..sources.providers import http_responder, local_server_up, missing_credential
from .calling import call_models
from .costs import check_stages


def available_models(config: dict, mock: bool = False) -> tuple[list[str], list[tuple[str, str]]]:
    """(ready ids, [(id, reason)] of the others); the first reason counts; mock runs need a name only."""
    ready, skipped = [], []
    for m in config["models"]["evaluated"]:
        reason = None if m.get("name") else "its name is not chosen yet"
        if not reason and not mock:
            reason = missing_credential(m["provider"])
            if not reason and m["provider"] == "local_hf" and not local_server_up():
                reason = "its local server is not reachable"
        if reason:
            skipped.append((m["id"], reason))
        else:
            ready.append(m["id"])
    return ready, skipped


def select_models(config: dict, requested: list[str], mock: bool = False) -> tuple[list[dict], list[tuple[str, str]]]:
    """(configurations of the requested models that can run, in the caller's order; [(id, reason)] of the others)."""
    special = {k: config["models"].get(k) for k in ("rewriter", "verifier")}
    known: dict[str, dict] = {}
    for m in config["models"]["evaluated"]:
        known.setdefault(m["id"], m)
    ready, reasons = available_models(config, mock)
    why, chosen, left = dict(reasons), [], []
    for name in requested:
        entry = special.get(name) if mock and name in special else known.get(name)
        if entry is None:
            left.append((name, "it is not in the configuration"))
        elif not entry.get("name"):
            left.append((name, "its name is not chosen yet"))
        elif not mock and name not in ready:
            left.append((name, why.get(name, "it is not ready")))
        else:
            chosen.append({"temperature": 0, "max_tokens": 16, "seed": None} | entry | {"id": name})
    return chosen, left


def malformed_items(items: DataFrame) -> DataFrame:
    """(item_id, problem) of items without any option A to D, or else without gold."""
    none = F.coalesce(~F.arrays_overlap(F.map_keys("options"), F.array(*[F.lit(x) for x in schemas.LETTERS])), F.lit(True))
    problem = F.when(none, "no option A to D").when(F.col("gold").isNull(), "no gold answer")
    return items.select("item_id", problem.alias("problem")).where("problem is not null")


def check_items(items: DataFrame) -> None:
    """ValueError on the first malformed item found, before any call is paid for."""
    if bad := malformed_items(items).first():
        raise ValueError(f"item {bad['item_id']!r} has {bad['problem']}: no model gets it")


def requests(items: DataFrame, models: list[dict], template: str, condition: str) -> DataFrame:
    """Every item for every model, with its prompt.  The models are literals of the configuration, so this is no join."""
    entries = [
        F.struct(
            F.lit(k).alias("order"), F.lit(m["id"]).alias("model_id"), F.lit(m["name"]).alias("model"), F.lit(m["provider"]).alias("provider"),
            F.lit(float(m["temperature"])).alias("temperature"), F.lit(int(m["max_tokens"])).alias("max_tokens"), F.lit(m["seed"]).cast("long").alias("seed"),
        )
        for k, m in enumerate(models)
    ]
    names = ["model_id", "model", "provider", "temperature", "max_tokens", "seed"]
    numbered = items.withColumn("__row", F.monotonically_increasing_id()).withColumn("m", F.explode(F.array(*entries)))
    return numbered.select(
        "item_id", "level", "gold", F.lit(condition).alias("prompt_condition"), *[F.col(f"m.{n}").alias(n) for n in names],
        F.struct(F.col("m.order").alias("order"), F.col("__row").alias("row")).alias("position"),
        render_prompt(template, F.col("stem"), F.col("options")).alias("prompt"),
    )


#: Fixed value: levels that a condition is limited to; others apply to all.
SCOPES = {"clarify_first": ("c",)}


def in_scope(items: DataFrame, conditions: list[str], scopes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``items`` once for each of the conditions that applies to its level, with ``prompt_condition``."""
    scopes = SCOPES if scopes is None else scopes
    rows = items.withColumn("prompt_condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    applies = F.lit(True)
    for condition, levels in scopes.items():
        applies = applies & ((F.col("prompt_condition") != condition) | F.coalesce(F.col("level").isin(*levels), F.lit(False)))
    return rows.where(applies)


def unfinished(work: DataFrame, done: DataFrame, key: tuple[str, ...] = schemas.RESULT_KEY) -> DataFrame:
    """Rows of ``work`` whose key is not in ``done``; null key fields equal each other, so items without a level are not run again."""
    other = done.select(*[F.col(k).alias(f"__{k}") for k in key])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return work.join(other, on, "left_anti")


def first_of_key(work: DataFrame, key: tuple[str, ...] = schemas.RESULT_KEY) -> DataFrame:
    """``work`` with ``repeated``: true for rows after the first of their key by position."""
    return work.withColumn("repeated", F.row_number().over(Window.partitionBy(*key).orderBy("position")) > 1)


def mock_calls(work: DataFrame) -> DataFrame:
    """``work`` as ``call_models`` gives it, answered by expressions: no call, no Python."""
    marked = first_of_key(work)
    once = lambda c: F.when(~F.col("repeated"), c)
    return marked.select(
        *work.columns,
        once(mock_answer(F.col("item_id"), F.col("model_id"), F.col("prompt_condition"))).alias("raw_output"),
        once(mock_tokens(F.col("prompt"))).alias("input_tokens"), once(F.lit(1).cast("long")).alias("output_tokens"),
        once(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("ts"),
        F.when(F.col("repeated"), "skipped").otherwise("run").alias("status"),
        F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_message"),
    )


def results_of(staged: DataFrame, prompt_hash: str, config_version: int | None, valid_letters=schemas.LETTERS) -> DataFrame:
    """The results of answered calls."""
    predicted = parse_answer(F.col("raw_output"), valid_letters)
    parsed = staged.where("status = 'run'").withColumn("predicted", predicted)
    extra: dict[str, Column] = {"correct": is_correct(F.col("predicted"), F.col("gold")), "prompt_hash": F.lit(prompt_hash), "config_version": F.lit(config_version).cast("int")}
    return parsed.withColumns(extra).select(*schemas.RESULTS.fieldNames())


def calls_of(staged: DataFrame, stage: str, rates: DataFrame, config_version: int | None) -> DataFrame:
    """The call log of answered calls."""
    if stage not in schemas.STAGES:
        raise ValueError(f"stage must be one of {sorted(schemas.STAGES)}, got {stage!r}")
    named = staged.where("status = 'run'").withColumns({"stage": F.lit(stage), "config_version": F.lit(config_version).cast("int")})
    return price(check_stages(named), rates).select(*schemas.CALLS.fieldNames())


def failures_of(results: DataFrame) -> DataFrame:
    """The parse failures among results."""
    ts = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return results.where("predicted is null").select(ts.alias("ts"), "item_id", "model", F.coalesce("level", F.lit("")).alias("level"), "prompt_condition", "raw_output")


#: Calls in a batch, where the caller sets no number of batches.
BATCH_CALLS = 2_000


def _log(spark: SparkSession, staged: DataFrame, stage: str, config: dict, out_dir: str, again: bool = False) -> None:
    """Appends what staged calls give to the three logs.  ``again``: rows that an interrupted call has appended are left out."""
    first = staged.select("prompt_hash", "config_version").first()
    if first is None:
        return
    letters = (config.get("parsing") or {}).get("valid_letters") or schemas.LETTERS
    results = results_of(staged, first["prompt_hash"], first["config_version"], letters)
    calls = calls_of(staged, stage, cfg.rates_table(spark, config), first["config_version"])
    for name, rows, key, schema in (
        ("results", results, (*schemas.RESULT_KEY, "prompt_hash"), schemas.RESULTS),
        ("calls", calls, (*schemas.CALL_KEY, "prompt_condition"), schemas.CALLS),
        ("parse_failures", failures_of(results), schemas.RESULT_KEY, schemas.PARSE_FAILURES),
    ):
        path = f"{out_dir}/{name}"
        append_log(unfinished(rows, key_scan(spark, path, key, schema), key) if again else rows, path)


def recover(spark: SparkSession, config: dict, out_dir: str) -> int:
    """Logs the calls that a run staged but did not finish logging, and returns the number of such batches.

    A staged batch goes once it is logged, so a paid call is neither lost nor made again.
    """
    folder = f"{out_dir}/_staged"
    found = file_names(spark, f"{folder}/*")
    for name in found:
        if path_exists(spark, f"{folder}/{name}/_SUCCESS"):
            _log(spark, spark.read.parquet(f"{folder}/{name}"), name.split("-")[0], config, out_dir, again=True)
        delete_path(spark, f"{folder}/{name}")
    return len(found)


def run_model(spark: SparkSession, config: dict, model_id: str, item: dict, template_path: str, *, condition: str | None = None, mock: bool = False, responder=http_responder, sleep=None) -> dict:
    """One item (item_id, stem, options, gold, maybe level) on one model, unlogged: the fields of its result, and the call's tokens and status.

    ValueError if the model cannot run or the item is malformed; an error of the call gives status 'failed' with its type and message.
    """
    chosen, left = select_models(config, [model_id], mock)
    if not chosen:
        raise ValueError(f"{model_id}: {left[0][1]}")
    items = spark.createDataFrame([{k: item.get(k) for k in schemas.ITEMS.fieldNames()}], schemas.ITEMS)
    check_items(items)
    template, digest = cfg.read_prompt(template_path)
    version = (config.get("run") or {}).get("config_version")
    work = requests(items, chosen, template, condition or Path(template_path).stem).withColumns({"prompt_hash": F.lit(digest), "config_version": F.lit(version).cast("int")})
    called = mock_calls(work) if mock else call_models(work, responder, **({"sleep": sleep} if sleep else {}))
    letters = (config.get("parsing") or {}).get("valid_letters") or schemas.LETTERS
    predicted = parse_answer(F.col("raw_output"), letters)
    row = called.withColumn("predicted", predicted).withColumn("correct", is_correct(F.col("predicted"), F.col("gold"))).first().asDict()
    return {k: row[k] for k in (*schemas.RESULTS.fieldNames(), "input_tokens", "output_tokens", "status", "error_type", "error_message")}


def run_batch(
    spark: SparkSession, items: DataFrame, model_ids: list[str], template_path: str, *, config: dict, out_dir: str, stage: str = "eval", condition: str | None = None,
    mock: bool = False, responder=http_responder, batches: int | None = None, pause: float = 0.0, parallel: int | None = None, strict_version: bool = False, sleep=None,
) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Runs every item on every model that can run and appends the logs; ({run, skipped, failed}, [(model, reason skipped)]).

    Work whose key is in the results log is skipped before any call; ``strict_version`` adds prompt_hash and config_version
    to the key, so an edited prompt is run again.  Calls of a batch are written to a staging table once, and results,
    costs, parse failures and counts are read from it; work is dealt to ``batches`` (one for every BATCH_CALLS calls) by a
    hash of the key, each finished before the next.  Staged calls that an interrupted run did not log are logged first, so only
    calls under way at the time are lost.
    """
    template, digest = cfg.read_prompt(template_path)
    condition = condition or Path(template_path).stem
    version = (config.get("run") or {}).get("config_version")
    models, left_out = select_models(config, model_ids, mock)
    counts = {"run": 0, "skipped": 0, "failed": 0}
    if not models:
        return counts, left_out
    check_items(items)
    key = schemas.RESULT_KEY + (("prompt_hash", "config_version") if strict_version else ())
    work = requests(items, models, template, condition).withColumns({"prompt_hash": F.lit(digest), "config_version": F.lit(version).cast("int")})
    results_path = f"{out_dir}/results"
    recover(spark, config, out_dir)
    batches = batches or max(1, -(-work.count() // BATCH_CALLS))
    for k in range(batches):
        part = work.where(F.pmod(F.xxhash64(*schemas.RESULT_KEY), F.lit(batches)) == k) if batches > 1 else work
        todo = unfinished(part, key_scan(spark, results_path, key, schemas.RESULTS), key)
        staged_path = f"{out_dir}/_staged/{stage}-{uuid.uuid4().hex}"
        options = {"pause": pause, "parallel": parallel} | ({"sleep": sleep} if sleep else {})
        staged = mock_calls(todo) if mock else call_models(todo, responder, **options)
        staged.write.parquet(staged_path)
        staged = spark.read.parquet(staged_path)
        _log(spark, staged, stage, config, out_dir)
        found = {r["status"]: r["n"] for r in staged.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts["run"] += found.get("run", 0)
        counts["failed"] += found.get("failed", 0)
        counts["skipped"] += part.count() - found.get("run", 0) - found.get("failed", 0)
        delete_path(spark, staged_path)
    return counts, left_out
