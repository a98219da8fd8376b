"""The sanity check: a small seeded sample on every ready model, summarised and judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..sources import config as cfg
from ..sources.items import mock_items
from ..sources.logs import overwrite_log
from ..sources.providers import http_responder
from .calling import call_models
from .evaluation import available_models, calls_of, check_items, mock_calls, requests, results_of, select_models
from .sampling import sample
from .scoring import sanity_summary, verdicts

#: Items of a check, and what published accuracies allow at that size.
N_ITEMS = 50
TARGETS = [
    ("medgemma", 0.48, 0.80, 0.644, "published"),
    ("llama3", 0.65, 0.92, 0.79, "by models of its class"),
    ("gpt_closed", 0.0, 1.0, None, "not chosen yet"),
]


def run_sanity_check(spark: SparkSession, config: dict, template_path: str, out_dir: str, *, questions: DataFrame | None = None, mock: bool = False, responder=http_responder, targets=None) -> DataFrame | None:
    """The judged summary, a row per model; None if no model is ready.  ``questions`` are items to draw from (mock items without);
    results of a former check in ``out_dir`` are replaced, calls are added to its log."""
    seed = config["run"]["seed"]
    items = mock_items(spark, N_ITEMS, seed) if questions is None else sample(questions, N_ITEMS, seed, "item_id")
    ready, _ = available_models(config, mock)
    if not ready:
        return None
    check_items(items)
    template, digest = cfg.read_prompt(template_path)
    models, _ = select_models(config, ready, mock)
    work = requests(items, models, template, "plain")
    staged = mock_calls(work) if mock else call_models(work, responder)
    staged.write.mode("overwrite").parquet(f"{out_dir}/_sanity_staged")
    staged = spark.read.parquet(f"{out_dir}/_sanity_staged")
    version = config["run"].get("config_version")
    letters = (config.get("parsing") or {}).get("valid_letters") or schemas.LETTERS
    calls_of(staged, "pilot", cfg.rates_table(spark, config), version).write.mode("append").option("ignoreNullFields", "false").json(f"{out_dir}/calls")
    results = results_of(staged, digest, version, letters)
    overwrite_log(results, f"{out_dir}/sanity_check_results")
    outcome = results.select("item_id", "model", "predicted", "correct")
    attempts = staged.where("status <> 'skipped'").select("item_id", "model", "model_id", "status").join(outcome, ["item_id", "model"], "left")
    table = spark.createDataFrame(targets if targets is not None else TARGETS, schemas.TARGETS)
    return verdicts(sanity_summary(attempts), table).orderBy(F.col("model_id"))
