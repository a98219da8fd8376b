"""python -m gradus.cli validate CONFIG | costs CONFIG LOG | merge FOLDER OUT | sanity CONFIG TEMPLATE OUT [--mock]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gradus").getOrCreate()


def validate(config_path: str) -> int:
    from .operators import rules
    from .sources.config import load_config

    config, root = load_config(config_path), Path(config_path).parent
    for path, digest in rules.prompt_hashes(config, root).items():
        print(f"  hash   {path}  {digest}")
    found = rules.findings(config, root)
    for rule, severity, subject, message in sorted(found, key=lambda x: x[1], reverse=True):
        print(f"  {severity:<6} {rule} {subject}: {message}")
    blocks = sum(x[1] == "BLOCK" for x in found)
    print(f"{blocks} blocking, {len(found) - blocks} warnings")
    return rules.exit_code(found)


def costs(config_path: str, log: str) -> int:
    from .operators.costs import summarize
    from .schemas import CALLS
    from .sources.logs import rows_of, scan_log

    rows = summarize(rows_of(scan_log(_session(), log, CALLS))).orderBy("scope", "name").collect()
    if not rows:
        print("No calls logged yet.")
    for r in rows:
        print(f"{r['scope']:<6} {r['name'] or '':<40} {r['calls']:>10,} {r['input_tokens']:>12,} {r['output_tokens']:>12,} {r['usd']:>10.2f}  {r['unpriced'] or ''}")
    if any(r["scope"] == "total" and r["unpriced"] for r in rows):
        print("Calls without a price make the total a lower bound.")
    return 0


def merge(folder: str, out: str) -> int:
    from .operators.merging import merge_logs
    from .sources.logs import overwrite_log

    try:
        calls, people, stages = merge_logs(_session(), folder)
    except FileNotFoundError as e:
        print(e)
        return 1
    overwrite_log(calls, out)
    for r in people.orderBy("person").collect():
        print(f"{r['person']:<16} {r['calls']:>10,} {r['usd']:>10.2f}")
    for r in stages.orderBy(stages["stage"].asc_nulls_last()).collect():
        print(f"{r['stage'] or 'TEAM TOTAL':<16} {r['calls']:>10,} {r['usd']:>10.2f}")
    return 0


def sanity(config_path: str, template: str, out: str, mock: bool) -> int:
    from .operators.sanity import run_sanity_check
    from .operators.scoring import exit_code
    from .sources.config import load_config

    judged = run_sanity_check(_session(), load_config(config_path), template, out, mock=mock)
    if judged is None:
        print("No model is ready.")
        return 2
    for r in judged.collect():
        print(f"{r['model_id']:<12} n={r['n']} acc={r['accuracy']:.1%} unparsed={r['parse_fail_rate']:.1%} errors={r['error_rate']:.1%} {r['verdict']}")
    return exit_code(judged)


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="gradus", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    p = sub.add_parser("validate")
    p.add_argument("config")
    p = sub.add_parser("costs")
    p.add_argument("config")
    p.add_argument("log")
    p = sub.add_parser("merge")
    p.add_argument("folder")
    p.add_argument("out")
    p = sub.add_parser("sanity")
    p.add_argument("config")
    p.add_argument("template")
    p.add_argument("out")
    p.add_argument("--mock", action="store_true")
    a = parser.parse_args(argv)
    if a.what == "validate":
        return validate(a.config)
    if a.what == "costs":
        return costs(a.config, a.log)
    if a.what == "merge":
        return merge(a.folder, a.out)
    return sanity(a.config, a.template, a.out, a.mock)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
