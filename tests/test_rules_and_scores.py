import copy

import pytest
from pyspark.sql import functions as F

from gradus import schemas
from gradus.operators import rules, sampling, sanity, scoring, statistics

CONFIG = {
    "run": {"pilot_mode": True, "seed": 5, "config_version": 1},
    "dataset": {"n_items": None},
    "models": {
        "rewriter": {"name": "rw", "version": None, "temperature": 0},
        "verifier": {"name": "vf", "version": None, "temperature": 0},
        "evaluated": [
            {"id": "closed", "name": None, "version": None, "temperature": 0, "provider": "p"},
            {"id": "llama3", "name": "l", "version": None, "temperature": 0, "provider": "p"},
            {"id": "medgemma", "name": "m", "version": None, "temperature": 0, "provider": "p"},
        ],
    },
    "generation": {"rewriter_prompt": "rw.txt"},
    "prompt_conditions": [{"id": "plain", "template": "plain.txt"}],
    "gates": {"realism": {"max_rater_accuracy": 0.75}, "fidelity": {"min_filter_human_kappa": 0.6}},
    "cost_rates_usd_per_1m": {"rw": {"input": None, "output": None}, "l": {"input": 0.0, "output": 0.0}, "m": {"input": 0.0, "output": 0.0}},
}


@pytest.fixture
def root(tmp_path):
    (tmp_path / "rw.txt").write_text("{stem}")
    (tmp_path / "plain.txt").write_text("{stem} {options}")
    return tmp_path


def found(config, root):
    return [(r, s) for r, s, _, _ in rules.findings(config, root)]


def test_open_config(root):
    got = found(CONFIG, root)
    assert [x for x in got if x[1] == "BLOCK"] == [("V1", "BLOCK"), ("V7", "BLOCK")]
    assert sorted(r for r, s in got if s == "WARN") == ["V10", "V12", "V13", "V3", "V8", "V8"]
    assert rules.exit_code(rules.findings(CONFIG, root)) == 1 and set(rules.prompt_hashes(CONFIG, root)) == {"rw.txt", "plain.txt"}


def test_every_rule(root):
    c = copy.deepcopy(CONFIG)
    c["models"]["rewriter"] |= {"version": "1", "temperature": 1}
    c["models"]["verifier"]["name"] = "rw"
    c["models"]["evaluated"] = [{"id": "x", "name": "rw", "version": "1", "temperature": 0.5}]
    c["dataset"]["n_items"] = 1274
    c["gates"] = {"realism": {}, "fidelity": {}}
    (root / "plain.txt").write_text("{stem}")
    (root / "rw.txt").unlink()
    assert sorted(r for r, _ in found(c, root)) == sorted(["V2", "V3", "V4", "V5", "V6", "V9", "V11", "V13", "V14", "V15", "V16", "V17"])
    c["dataset"]["n_items"], c["run"]["pilot_mode"] = None, False
    assert ("V10", "BLOCK") in found(c, root)


def test_findings_table(spark, root):
    assert rules.findings_table(spark, CONFIG, root).where("severity = 'BLOCK'").count() == 2


def test_mock_sanity_check(spark, root, tmp_path):
    c = copy.deepcopy(CONFIG)
    judged = sanity.run_sanity_check(spark, c, str(root / "plain.txt"), str(tmp_path / "out"), mock=True)
    rows = {r["model_id"]: r for r in judged.collect()}
    assert set(rows) == {"llama3", "medgemma"} and all(r["n"] == 50 and 0.05 < r["accuracy"] < 0.5 and r["parse_fail_rate"] == 0 for r in rows.values())
    assert scoring.exit_code(judged) == 1
    c["models"]["evaluated"] = c["models"]["evaluated"][:1]
    assert sanity.run_sanity_check(spark, c, str(root / "plain.txt"), str(tmp_path / "out"), mock=True) is None


def test_verdicts(spark):
    s = "model_id string, n int, errored int, accuracy double, parse_fail_rate double, error_rate double"
    rows = [("edge", 1, 0, 0.5, 0.05, 0.05), ("low", 1, 0, 0.4, 0.0, 0.0), ("lost", 1, 0, 0.6, 0.06, 0.0), ("free", 1, 0, 0.0, 0.0, 0.0), ("freebad", 1, 0, 0.0, 0.0, 0.2), ("unknown", 1, 0, 0.6, 0.0, 0.0)]
    targets = [(m, 0.5, 0.8, 0.6, "") for m in ("edge", "low", "lost")] + [(m, 0.0, 1.0, None, "") for m in ("free", "freebad")]
    got = scoring.verdicts(spark.createDataFrame(rows, s), spark.createDataFrame(targets, schemas.TARGETS))
    assert {r["model_id"]: r["verdict"] for r in got.collect()} == {"edge": "PASS", "low": "CHECK", "lost": "CHECK", "free": "N/A", "freebad": "CHECK", "unknown": "CHECK"}
    assert scoring.exit_code(got) == 1 and scoring.exit_code(got.where("model_id = 'edge'")) == 0 and scoring.exit_code(got.limit(0)) == 2


def results(spark, rows):
    return spark.createDataFrame(rows, "item_id string, model string, level string, prompt_condition string, predicted string, correct boolean")


def test_accuracy_and_gap(spark):
    r = results(spark, [("1", "m", "a", "p", "A", True), ("2", "m", "a", "p", None, None), ("1", "m", "c", "p", "B", False), ("2", "m", "c", "p", "A", True), ("1", "n", "a", "p", None, None)])
    got = {x["model"]: (x["n"], x["scored"], x["accuracy"], x["parse_fail_rate"]) for x in scoring.accuracy(r, "model").collect()}
    assert got == {"m": (4, 3, 2 / 3, 0.25), "n": (1, 0, 0.0, 1.0)}
    gap = scoring.literacy_gap(r.where("model = 'm'"), "model").first()
    assert gap["gap"] == 0.5 and gap["acc_b"] is None and gap["controlled_gap"] is None


def test_mcnemar_and_kappa(spark):
    rows = [(str(i), "m", lv, "p", "A", ok) for i in range(10) for lv, ok in (("a", i < 8), ("c", i < 3))]
    got = statistics.mcnemar(statistics.paired(results(spark, rows)), "model").first()
    assert (got["n"], got["only_first"], got["only_second"]) == (10, 5, 0) and got["statistic"] == 16 / 5
    rated = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15 + [(None, 1)], "x int, y int")
    k = statistics.cohen_kappa(rated, "x", "y").first()
    assert k["n"] == 50 and abs(k["kappa"] - 0.4) < 1e-12
    assert statistics.cohen_kappa(rated.where("x = 1 and y = 1"), "x", "y").first()["kappa"] is None


def test_gates(spark):
    left, right = spark.createDataFrame([(4.0,), (5.0,)], "v double"), spark.createDataFrame([(3.81,)], "v double")
    assert statistics.shift_gate(left, right, "v", least=0.69).first()["passes"] is False
    assert statistics.shift_gate(left, right, "v", least=0.68).first()["passes"] is True
    a = spark.createDataFrame([("x", 1, False), ("x", 2, True), ("y", 1, False), ("y", 2, None), ("y", 3, False), ("y", 4, True)], "item_id string, attempt int, passed boolean")
    assert tuple(statistics.drop_rate(a).first()) == (2, 1, 0.5)
    assert {tuple(r) for r in statistics.last_attempts(a).collect()} == {("x", 2, True), ("y", 3, False)}


def test_jargon_scores(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, None)], "i int, text string")
    got = {r["i"]: r["jargon"] for r in statistics.jargon_scores(df, lambda: lambda texts: [float(len(t)) for t in texts]).collect()}
    assert got == {1: 4.0, 2: None}


def test_least_shift(spark):
    one = lambda v: spark.createDataFrame([(v,)], "v double")
    assert statistics.shift_gate(one(4.52), one(3.0), "v", least=0.69).first()["passes"] is True


def test_samples(spark):
    df = spark.range(100)
    one, two = sampling.sample(df, 10, 1, "id"), sampling.sample(df.repartition(9), 10, 1, "id")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(one) == ids(two) and len(ids(one)) == 10 and ids(one) != ids(sampling.sample(df, 10, 2, "id")) and len(ids(sampling.sample(df, 200, 1, "id"))) == 100
    strata = sampling.stratified_sample(df.withColumn("s", F.col("id") % 3), 4, 1, "id", "s").groupBy("s").count().collect()
    assert sorted(r["count"] for r in strata) == [4, 4, 4]


def test_cli(root, capsys):
    import yaml

    from gradus import cli

    (root / "config.yaml").write_text(yaml.safe_dump(CONFIG))
    assert cli.main(["validate", str(root / "config.yaml")]) == 1
    assert "2 blocking, 6 warnings" in capsys.readouterr().out
