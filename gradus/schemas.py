"""Fixed schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "boolean": BooleanType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "map<string,string>": MapType(StringType(), StringType())}


def _schema(columns: str) -> StructType:
    """From ``name type, ...``, without a session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


LETTERS = ("A", "B", "C", "D")
LEVELS = ("a", "b", "c")
#: The stages that a call may be logged under.
STAGES = ("rewrite", "verify", "eval", "intervention", "pilot", "other")

ITEMS = _schema("item_id string, stem string, options map<string,string>, gold string, level string")
RESULTS = _schema(
    "item_id string, model string, level string, prompt_condition string, predicted string, gold string, correct boolean, raw_output string, prompt_hash string, config_version int"
)
CALLS = _schema(
    "ts string, stage string, model string, input_tokens bigint, output_tokens bigint, cost_usd double, config_version int, item_id string, level string, prompt_condition string"
)
PARSE_FAILURES = _schema("ts string, item_id string, model string, level string, prompt_condition string, raw_output string")
CALLS_MERGED = StructType([*CALLS.fields, StructField("_logged_by", StringType())])
RATES = _schema("model string, input double, output double")
MODELS = _schema("id string, provider string, name string, version string, temperature double, max_tokens int, seed bigint, dtype string")
CONDITIONS = _schema("id string, template string")
TARGETS = _schema("model_id string, min_acc double, max_acc double, point double, note string")
REWRITES = _schema("item_id string, prompt_hash string, config_version int, raw string")

RESULT_KEY = ("item_id", "model", "level", "prompt_condition")
CALL_KEY = ("ts", "stage", "model", "input_tokens", "output_tokens", "item_id")
