"""Rules a configuration has to meet before anything is run, as a table over views of the configuration.

A view gives rows (dicts with ``subject``) of one part of the configuration; a rule names a view, its severity, what is wrong
in a row, and how to say it.  Findings are rows (rule, severity, subject, message).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Items of the test split, and the limits of the two gates.
MAX_ITEMS, MAX_RATER, MIN_KAPPA = 1273, 0.75, 0.6
FINDINGS = "rule string, severity string, subject string, message string"
BLOCK, WARN = "BLOCK", "WARN"


def _uses(config: dict) -> list[dict]:
    """Every use of a model: role, id, name, version, temperature, and all roles that its name has."""
    models = config["models"]
    uses = [models[role] | {"role": role, "subject": role} for role in ("rewriter", "verifier")]
    uses += [m | {"role": "evaluated", "subject": m.get("id", "?")} for m in models["evaluated"]]
    roles: dict[str, set[str]] = {}
    for use in uses:
        roles.setdefault(use.get("name"), set()).add(use["role"])
    return [use | {"roles": roles[use.get("name")]} for use in uses]


def _named(config: dict) -> Iterator[dict]:
    """As uses, with the model's name as subject; uses without a name are left out."""
    return (use | {"subject": use["name"]} for use in _uses(config) if use.get("name"))


def _rates(config: dict) -> Iterator[dict]:
    """Each name in use once, with its rate."""
    rates = config.get("cost_rates_usd_per_1m") or {}
    for name in sorted({use["name"] for use in _named(config)}):
        yield {"subject": name, "rate": rates.get(name)}


def _prompts(config: dict, root: Path) -> Iterator[dict]:
    """Each prompt file, with what is missing in it (None: the file itself)."""
    for path, needed in required_placeholders(config).items():
        file = root / path
        absent = sorted(x for x in needed if x not in file.read_text(encoding="utf-8")) if file.exists() else None
        yield {"subject": path, "absent": absent}


VIEWS: dict[str, Callable[[dict, Path], object]] = {
    "use": lambda c, root: _uses(c),
    "name": lambda c, root: _named(c),
    "rate": lambda c, root: _rates(c),
    "prompt": _prompts,
    "size": lambda c, root: [{"subject": "dataset", "n": c["dataset"].get("n_items"), "pilot": bool(c["run"].get("pilot_mode"))}],
    "realism": lambda c, root: [{"subject": "realism", "most": c["gates"]["realism"].get("max_rater_accuracy", 1)}],
    "fidelity": lambda c, root: [{"subject": "fidelity", "least": c["gates"]["fidelity"].get("min_filter_human_kappa", 0)}],
}


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    view: str
    wrong: Callable[[dict], object]
    message: str


def _of(role: str, wrong: Callable[[dict], object]) -> Callable[[dict], object]:
    return lambda use: use["role"] == role and wrong(use)


_unpinned = lambda use: not use.get("version")
_warm = lambda use: use.get("temperature") != 0
_open = lambda use: not use.get("name")

RULES = (
    Rule("V10", WARN, "size", lambda d: d["n"] is None and d["pilot"], "the number of items is open in a pilot"),
    Rule("V10", BLOCK, "size", lambda d: d["n"] is None and not d["pilot"], "the number of items is open"),
    Rule("V11", BLOCK, "size", lambda d: d["n"] is not None and d["n"] > MAX_ITEMS, "{n} items are more than the test split has"),
    Rule("V16", WARN, "realism", lambda g: g["most"] > MAX_RATER, "raters may tell {most} of the rewrites"),
    Rule("V17", WARN, "fidelity", lambda g: g["least"] < MIN_KAPPA, "a kappa of {least} is enough"),
    Rule("V14", BLOCK, "prompt", lambda p: p["absent"] is None, "there is no such file"),
    Rule("V15", BLOCK, "prompt", lambda p: p["absent"], "it lacks {absent}"),
    Rule("V12", WARN, "rate", lambda r: r["rate"] is None, "its calls will have no cost"),
    Rule("V13", WARN, "rate", lambda r: r["rate"] is not None and None in (r["rate"].get("input"), r["rate"].get("output")), "its rate lacks a side"),
    Rule("V4", BLOCK, "use", _of("verifier", lambda use: "rewriter" in use["roles"]), "it would check its own rewrites"),
    Rule("V5", BLOCK, "name", _of("rewriter", lambda use: "evaluated" in use["roles"]), "it would answer its own rewrites"),
    Rule("V6", WARN, "name", _of("verifier", lambda use: "evaluated" in use["roles"]), "it is evaluated as well"),
    Rule("V7", BLOCK, "use", _of("evaluated", _open), "no model is chosen"),
    Rule("V1", BLOCK, "use", _of("rewriter", _unpinned), "its version is open"),
    Rule("V3", WARN, "use", _of("verifier", _unpinned), "its version is open"),
    Rule("V8", WARN, "use", _of("evaluated", lambda use: not _open(use) and _unpinned(use)), "its version is open"),
    Rule("V2", BLOCK, "use", _of("rewriter", _warm), "its temperature is {temperature}"),
    Rule("V9", BLOCK, "use", _of("evaluated", lambda use: not _open(use) and _warm(use)), "its temperature is {temperature}"),
)


def findings(config: dict, root: str | Path = ".") -> list[tuple[str, str, str, str]]:
    """All findings, by the number of their rule."""
    views = {name: list(view(config, Path(root))) for name, view in VIEWS.items()}
    found = [(rule.name, rule.severity, str(row["subject"]), rule.message.format(**{"temperature": None} | row)) for rule in RULES for row in views[rule.view] if rule.wrong(row)]
    return sorted(found, key=lambda x: (int(x[0][1:]), x[1:]))


def required_placeholders(config: dict) -> dict[str, set[str]]:
    needed = {config["generation"]["rewriter_prompt"]: {"{stem}"}}
    return needed | {p["template"]: {"{stem}", "{options}"} for p in config.get("prompt_conditions") or []}


def missing_placeholders(template: Column, needed: tuple[str, ...] = ("{options}", "{stem}")) -> Column:
    """The placeholders that a template lacks, in the given order."""
    return F.filter(F.array(*[F.lit(x) for x in needed]), lambda x: ~F.contains(template, x))


def prompt_hashes(config: dict, root: str | Path = ".") -> dict[str, str]:
    """12 hex digits of the SHA-256 of each prompt file that exists, over its bytes."""
    files = {p: Path(root) / p for p in required_placeholders(config)}
    return {p: sha256(f.read_bytes()).hexdigest()[:12] for p, f in files.items() if f.exists()}


def findings_table(spark: SparkSession, config: dict, root: str | Path = ".") -> DataFrame:
    return spark.createDataFrame(findings(config, root), FINDINGS)


def exit_code(found: list[tuple[str, str, str, str]]) -> int:
    """1 if anything blocks, else 0: a configuration with warnings can run."""
    return int(any(x[1] == BLOCK for x in found))
