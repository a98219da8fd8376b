"""The run configuration: a YAML document on the driver, and its parts as small DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def load_config(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def read_prompt(path: str) -> tuple[str, str]:
    """(text, 12-hex hash of the text with line ends as ``\\n``)."""
    from hashlib import sha256

    text = Path(path).read_text(encoding="utf-8")
    return text, sha256(text.encode("utf-8")).hexdigest()[:12]


def rates_table(spark: SparkSession, config: dict) -> DataFrame:
    rates = config.get("cost_rates_usd_per_1m") or {}
    number = lambda x: None if x is None else float(x)
    rows = [(m, number((r or {}).get("input")), number((r or {}).get("output"))) for m, r in rates.items()]
    return spark.createDataFrame(rows, schemas.RATES)


def models_table(spark: SparkSession, config: dict) -> DataFrame:
    names = schemas.MODELS.fieldNames()
    rows = []
    for m in config["models"]["evaluated"]:
        full = {"temperature": 0, "max_tokens": 16} | m
        rows.append(tuple(float(full[k]) if k == "temperature" and full.get(k) is not None else full.get(k) for k in names))
    return spark.createDataFrame(rows, schemas.MODELS)


def conditions_table(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(p["id"], p["template"]) for p in config.get("prompt_conditions") or []]
    return spark.createDataFrame(rows, schemas.CONDITIONS)
