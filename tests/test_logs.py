import json

from hypothesis import HealthCheck, given, settings, strategies as st

from gradus import schemas
from gradus.operators import costs, merging
from gradus.sources import logs


def call(i, **more):
    base = {"ts": f"2024-01-0{i % 9 + 1}", "stage": "eval", "model": "m", "input_tokens": i, "output_tokens": 1, "cost_usd": 0.5, "config_version": 1, "item_id": f"i{i}"}
    return base | more


def write(path, *lines):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines), encoding="utf-8")


def test_scan_skips_and_tells(spark, tmp_path):
    write(tmp_path / "log.jsonl", call(1), "", "{broken", "   ", call(2, cost_usd=None, extra="x"), "[1]", "'text'")
    log = logs.numbered_log(spark, str(tmp_path / "log.jsonl"), schemas.CALLS)
    assert sorted(r["item_id"] for r in logs.rows_of(log).collect()) == ["i1", "i2"]
    assert sorted((r["line_no"], r["malformed"]) for r in logs.malformed_lines(log).collect()) == [(3, "{broken"), (6, "[1]"), (7, "'text'")]
    assert logs.rows_of(logs.scan_log(spark, str(tmp_path / "log.jsonl"), schemas.CALLS)).count() == 2
    assert logs.scan_log(spark, str(tmp_path / "none.jsonl"), schemas.CALLS).count() == 0


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = {name: [call(i) if i % 7 else ("" if i % 2 else "{x") for i in range(n)] for name, n in (("a.jsonl", 900), ("b.jsonl", 1), ("c.jsonl", 300))}
    for name, rows in lines.items():
        write(tmp_path / name, *rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            log = logs.numbered_log(spark, str(tmp_path / "*.jsonl"), schemas.CALLS)
            got = {(r["file_name"], r["line_no"], r["item_id"]) for r in log.collect()}
            assert got == {(n, i + 1, f"i{i}" if i % 7 else None) for n, rows in lines.items() for i, x in enumerate(rows) if x != ""}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_nulls_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("i", None)], "item_id string, level string")
    logs.append_log(df, str(tmp_path / "out"))
    logs.append_log(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert text.count('"level":null') == 2


def test_merge(spark, tmp_path):
    write(tmp_path / "api_calls_ana.jsonl", call(1), call(2), call(1), call(3, cost_usd=None))
    write(tmp_path / "api_calls_bo_api_calls_.jsonl", call(2), call(4, ts=None), "{oops")
    write(tmp_path / "api_calls_cy.jsonl")
    write(tmp_path / "api_calls_dee.jsonl", call(1))
    calls, people, stages = merging.merge_logs(spark, str(tmp_path))
    rows = calls.collect()
    assert [(r["item_id"], r["_logged_by"]) for r in rows] == [("i4", "bo_"), ("i1", "ana"), ("i2", "ana"), ("i3", "ana")]
    got = {r["person"]: (r["calls"], r["usd"], r["unpriced"], r["duplicates"]) for r in people.collect()}
    assert got == {"ana": (3, 1.0, 1, 1), "bo_": (1, 0.5, 0, 1), "cy": (0, 0.0, 0, 0), "dee": (0, 0.0, 0, 1)}
    assert {(r["stage"], r["calls"], r["usd"], r["unpriced"]) for r in stages.collect()} == {("eval", 4, 1.5, 1), (None, 4, 1.5, 1)}


def test_no_logs(spark, tmp_path):
    try:
        merging.merge_logs(spark, str(tmp_path))
    except FileNotFoundError:
        return
    raise AssertionError


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["f1", "f2"]), st.integers(0, 3)), min_size=1, max_size=20))
def test_dedup_is_idempotent_and_ignores_partitions(spark, picks):
    rows = [(f, i, str(k), "eval", "m", k, 1, None) for i, (f, k) in enumerate(picks)]
    df = spark.createDataFrame(rows, "file_name string, line_no long, ts string, stage string, model string, input_tokens long, output_tokens long, item_id string")
    once = merging.mark_first(df).where("kept").drop("kept")
    other = merging.mark_first(df.repartition(7)).where("kept").drop("kept")
    again = merging.mark_first(once).where("kept").drop("kept")
    key = lambda d: sorted(map(str, d.collect()))
    assert key(once) == key(other) == key(again)
    want = {}
    for f, i, ts, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        want.setdefault(ts, (f, i))
    assert {(r["ts"], (r["file_name"], r["line_no"])) for r in once.collect()} == set(want.items())


def test_cost_rollups(spark):
    from gradus.functions.pricing import price

    rates = spark.createDataFrame([("free", 0.0, 0.0), ("half", None, 1.0), ("paid", 2.0, 4.0)], schemas.RATES)
    rows = [("eval", "free", 10, 1), ("eval", "half", 10, 1), ("pilot", "paid", 1_000_000, 500_000), ("pilot", "other", 1, 1)]
    calls = price(spark.createDataFrame(rows, "stage string, model string, input_tokens long, output_tokens long"), rates)
    assert {r["model"]: r["cost_usd"] for r in calls.collect()} == {"free": 0.0, "half": None, "paid": 4.0, "other": None}
    got = {(r["scope"], r["name"]): (r["calls"], r["input_tokens"], r["usd"], r["unpriced"]) for r in costs.summarize(calls).collect()}
    assert got[("total", None)] == (4, 1_000_021, 4.0, 2) and got[("stage", "eval")] == (2, 20, 0.0, 1) and got[("model", "half")] == (1, 10, 0.0, 1)
    assert costs.summarize(calls.limit(0)).count() == 0
    assert costs.project(calls, 2.5).first()["projected_usd"] == 10.0 and costs.project(calls.limit(0), 2.5).first()["projected_usd"] == 0.0


def test_unknown_stage_fails(spark):
    import pytest

    df = spark.createDataFrame([("eval",), ("nope",)], "stage string")
    with pytest.raises(Exception, match="stage must be one of"):
        costs.check_stages(df).collect()


def test_a_folder_is_one_log_in_order_of_its_parts(spark, tmp_path):
    part = lambda n: f"part-{n:05d}-x-c000.json"
    ana, bo = tmp_path / "api_calls_ána +%20b.jsonl", tmp_path / "api_calls_bo.jsonl"
    ana.mkdir()
    rows = [call(i) if i % 5 else "" for i in range(60)]
    for at, n in ((0, 0), (20, 99_999), (40, 100_000)):
        write(ana / part(n), *rows[at : at + 20])
    (ana / "_SUCCESS").write_text("")
    write(ana / part(7))
    write(bo, call(70), "{x")
    (tmp_path / "api_calls_cy.jsonl").mkdir()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = {(ana.name, i + 1, f"i{i}") for i in range(60) if i % 5} | {("api_calls_bo.jsonl", 1, "i70"), ("api_calls_bo.jsonl", 2, None)}
    try:
        for size in ("512", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = merging.read_shared_logs(spark, str(tmp_path)).select("file_name", "line_no", "item_id").collect()
            assert len(got) == len(want) and set(map(tuple, got)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    people = {r["person"]: r["calls"] for r in merging.merge_logs(spark, str(tmp_path))[1].collect()}
    assert people == {"ána +%20b": 48, "bo": 1, "cy": 0}


def lines_by_part(folder):
    return [n for p in sorted(folder.glob("part-*")) if (n := len(p.read_text().splitlines()))]


def test_merged_log_is_written_in_ordered_parts(spark, tmp_path):
    from gradus import cli

    (tmp_path / "in").mkdir()
    write(tmp_path / "in/api_calls_ana.jsonl", *[call(i, ts=f"{i * 7919 % 4000:04d}") for i in range(4000)])
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert cli.merge(str(tmp_path / "in"), str(tmp_path / "cli")) == 0
        calls, _, _ = merging.merge_logs(spark, str(tmp_path / "in"))
        logs.overwrite_log(calls, str(tmp_path / "out"))
        logs.overwrite_log(calls, str(tmp_path / "back"), [calls["ts"].desc()])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    up = [f"{i:04d}" for i in range(4000)]
    for name, want in (("cli", up), ("out", up), ("back", up[::-1])):
        n = lines_by_part(tmp_path / name)
        assert len(n) > 1 and max(n) < 2000 and sum(n) == 4000
        got = logs.numbered_log(spark, str(tmp_path / name), schemas.CALLS_MERGED).orderBy("line_no").select("line_no", "ts").collect()
        assert [tuple(r) for r in got] == list(enumerate(want, 1))


def test_log_files_are_written_in_ordered_parts(spark, sf_dir):
    from pathlib import Path

    from gradus.plans import fixtures as fx

    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        folder = fx.log_files(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    log = merging.read_shared_logs(spark, folder)
    rows = log.where("malformed is null").groupBy("file_name").count().collect()
    for r in rows:
        n = lines_by_part(Path(folder.removeprefix("file://")) / r["file_name"])
        assert len(n) > 1 and max(n) < 0.5 * sum(n) and sum(n) == r["count"] + 2
    assert {(r["file_name"], r["line_no"]) for r in logs.malformed_lines(log).collect()} == {(f"api_calls_{p}.jsonl", 2) for p in ("ana", "bo")}


def test_numbered_log_does_not_shuffle_lines(spark, tmp_path):
    write(tmp_path / "a.jsonl", call(1), "{x")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = logs.numbered_log(spark, str(tmp_path / "*.jsonl"), schemas.CALLS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
