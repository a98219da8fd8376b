import pytest
from pyspark.sql import functions as F

from gradus import schemas
from gradus.operators import evaluation
from gradus.operators.calling import with_retries
from gradus.sources import logs
from gradus.sources.providers import EndpointError, TransientFailure

CONFIG = {
    "run": {"config_version": 3, "seed": 1},
    "models": {
        "rewriter": {"name": "rw", "provider": "p"},
        "verifier": {"name": "vf", "provider": "p"},
        "evaluated": [
            {"id": "open", "provider": "p", "name": None},
            {"id": "one", "provider": "p", "name": "name-one", "temperature": 0},
            {"id": "two", "provider": "p", "name": "name-two", "max_tokens": 5, "seed": 9},
        ],
    },
    "cost_rates_usd_per_1m": {"name-one": {"input": 1.0, "output": 1.0}},
}


@pytest.fixture
def template(tmp_path):
    p = tmp_path / "plain_v1.txt"
    p.write_text("{stem}\n{options}\n", encoding="utf-8")
    return str(p)


def items(spark, n=5, **change):
    rows = [{"item_id": f"i{k}", "stem": f"s{k}", "options": {"A": "x", "B": "y"}, "gold": "A", "level": None if k == 0 else "a"} | change for k in range(n)]
    return spark.createDataFrame(rows, schemas.ITEMS)


def always(text="A"):
    return lambda provider: lambda request: {"text": text, "input_tokens": 7, "output_tokens": 2}


def run(spark, tmp_path, template, its, models=("one", "two"), **options):
    return evaluation.run_batch(spark, its, list(models), template, config=CONFIG, out_dir=str(tmp_path / "out"), **options)


def test_mock_run_and_resume(spark, tmp_path, template):
    counts, left = run(spark, tmp_path, template, items(spark), mock=True)
    assert counts == {"run": 10, "skipped": 0, "failed": 0} and left == []
    assert run(spark, tmp_path, template, items(spark), mock=True)[0] == {"run": 0, "skipped": 10, "failed": 0}
    assert run(spark, tmp_path, template, items(spark, 6), models=["one"], mock=True)[0] == {"run": 1, "skipped": 5, "failed": 0}
    results = logs.rows_of(logs.scan_log(spark, str(tmp_path / "out/results"), schemas.RESULTS))
    assert results.count() == 11 and results.where("predicted is null").count() == 0
    calls = logs.rows_of(logs.scan_log(spark, str(tmp_path / "out/calls"), schemas.CALLS)).collect()
    assert len(calls) == 11 and {c["cost_usd"] is None for c in calls if c["model"] == "name-two"} == {True}


def test_strict_version_runs_an_edited_prompt_again(spark, tmp_path, template):
    its = items(spark, 2)
    run(spark, tmp_path, template, its, models=["one"], mock=True)
    with open(template, "a", encoding="utf-8") as f:
        f.write("more")
    assert run(spark, tmp_path, template, its, models=["one"], mock=True)[0]["skipped"] == 2
    assert run(spark, tmp_path, template, its, models=["one"], mock=True, strict_version=True)[0]["run"] == 2


def test_one_failure_does_not_stop_others_and_is_tried_again(spark, tmp_path, template):
    def flaky(provider):
        def respond(request):
            if request["item_id"] == "i2":
                raise EndpointError("bad request", 400)
            return {"text": "B or A", "input_tokens": 1, "output_tokens": 1} if request["item_id"] == "i1" else {"text": "A"}

        return respond

    out = dict(models=["one"], responder=flaky, condition="plain")
    real = {**CONFIG}
    assert evaluation.available_models(real)[0] == ["one", "two"]
    assert run(spark, tmp_path, template, items(spark), **out)[0] == {"run": 4, "skipped": 0, "failed": 1}
    failures = logs.rows_of(logs.scan_log(spark, str(tmp_path / "out/parse_failures"), schemas.PARSE_FAILURES)).collect()
    assert [(f["item_id"], f["raw_output"]) for f in failures] == [("i1", "B or A")]
    assert run(spark, tmp_path, template, items(spark), **(out | {"responder": always()}))[0] == {"run": 1, "skipped": 4, "failed": 0}


def test_each_key_is_called_once_per_success(spark, tmp_path, template):
    seen = tmp_path / "seen"

    def counting(provider):
        def respond(request):
            first = not seen.exists()
            with open(seen, "a") as f:
                f.write(request["item_id"] + "\n")
            if first:
                raise EndpointError("no", 400)
            return {"text": "A"}

        return respond

    one = items(spark, 1)
    its = one.union(one).union(one)
    counts, _ = run(spark, tmp_path, template, its, models=["one"], responder=counting, batches=2)
    assert counts == {"run": 1, "skipped": 1, "failed": 1} and seen.read_text().split() == ["i0", "i0"]


@pytest.mark.parametrize("broken", ["results", "calls", "parse_failures"])
def test_an_interrupted_run_is_logged_without_calling_again(spark, tmp_path, template, monkeypatch, broken):
    asked, append = tmp_path / "asked", evaluation.append_log

    def counting(provider):
        def respond(request):
            with open(asked, "a") as f:
                f.write(request["item_id"] + "\n")
            return {"text": "A" if request["item_id"] != "i1" else "?", "input_tokens": 1, "output_tokens": 1}

        return respond

    def fails(df, path):
        if path.endswith(broken):
            raise OSError("the disk is full")
        append(df, path)

    monkeypatch.setattr(evaluation, "append_log", fails)
    with pytest.raises(OSError):
        run(spark, tmp_path, template, items(spark, 3), models=["one"], responder=counting)
    monkeypatch.setattr(evaluation, "append_log", append)
    assert run(spark, tmp_path, template, items(spark, 3), models=["one"], responder=counting)[0] == {"run": 0, "skipped": 3, "failed": 0}
    assert sorted(asked.read_text().split()) == ["i0", "i1", "i2"]
    rows = lambda name, schema: logs.rows_of(logs.scan_log(spark, str(tmp_path / "out" / name), schema)).count()
    assert (rows("results", schemas.RESULTS), rows("calls", schemas.CALLS), rows("parse_failures", schemas.PARSE_FAILURES)) == (3, 3, 1)


def test_one_item_on_one_model(spark, template):
    item = {"item_id": "i", "stem": "s", "options": {"A": "x"}, "gold": "A"}
    got = evaluation.run_model(spark, CONFIG, "one", item, template, responder=always("(A)"))
    assert (got["predicted"], got["correct"], got["status"], got["input_tokens"], got["model"]) == ("A", True, "run", 7, "name-one")
    assert evaluation.run_model(spark, CONFIG, "one", item, template, mock=True)["predicted"] in schemas.LETTERS
    assert evaluation.run_model(spark, CONFIG, "one", item, template, responder=always(None), sleep=lambda s: None)["status"] == "failed"
    for model, change in (("open", {}), ("one", {"gold": None})):
        with pytest.raises(ValueError):
            evaluation.run_model(spark, CONFIG, model, item | change, template, responder=always())


def test_clients_follow_their_credential(monkeypatch):
    from gradus.sources import providers

    made = []
    responder = lambda provider: made.append(provider) or object()
    monkeypatch.setenv("NVIDIA_API_KEY", "one")
    first = providers.client(responder, "nvidia_build")
    assert providers.client(responder, "nvidia_build") is first
    monkeypatch.setenv("NVIDIA_API_KEY", "two")
    assert providers.client(responder, "nvidia_build") is not first and made == ["nvidia_build"] * 2


def test_empty_answer_is_a_failed_row(spark, tmp_path, template):
    assert run(spark, tmp_path, template, items(spark, 2), models=["one"], responder=always(None))[0] == {"run": 0, "skipped": 0, "failed": 2}


def test_program_faults_end_the_job(spark, tmp_path, template):
    def broken(provider):
        raise ValueError("unknown provider")

    with pytest.raises(Exception, match="unknown provider"):
        run(spark, tmp_path, template, items(spark, 1), models=["one"], responder=broken)


def test_models_that_cannot_run(spark, tmp_path, template, monkeypatch):
    monkeypatch.delenv("NVIDIA_API_KEY", raising=False)
    config = CONFIG | {"models": CONFIG["models"] | {"evaluated": [{"id": "n", "provider": "nvidia_build", "name": "x"}, {"id": "open", "provider": "p", "name": None}]}}
    counts, left = evaluation.run_batch(spark, items(spark), ["n", "open", "typo"], template, config=config, out_dir=str(tmp_path / "o"))
    assert counts == {"run": 0, "skipped": 0, "failed": 0} and [x[0] for x in left] == ["n", "open", "typo"]
    assert evaluation.available_models(config, mock=True)[0] == ["n"]


@pytest.mark.parametrize("change", [{"gold": None}, {"options": {}}, {"options": {"E": "x"}}])
def test_malformed_items_abort_before_calls(spark, tmp_path, template, change):
    def never(provider):
        raise AssertionError

    with pytest.raises(ValueError):
        run(spark, tmp_path, template, items(spark, 2, **change), responder=never)


def test_configured_letters_count(spark, tmp_path, template):
    config = CONFIG | {"parsing": {"valid_letters": ["X", "Y"]}}
    evaluation.run_batch(spark, items(spark, 1), ["one"], template, config=config, out_dir=str(tmp_path / "out"), responder=always("A"))
    assert logs.rows_of(logs.scan_log(spark, str(tmp_path / "out/results"), schemas.RESULTS)).first()["predicted"] is None


def test_retries():
    pauses, left = [], [503, None, 429]

    def call():
        if left:
            raise EndpointError("x", left.pop(0))
        return {"text": "A"}

    assert with_retries(call, sleep=pauses.append, jitter=lambda a, b: 0) == {"text": "A"} and pauses == [1.5, 3.0, 6.0]
    pauses.clear()

    def down():
        raise EndpointError("x", 500)

    with pytest.raises(TransientFailure):
        with_retries(down, sleep=pauses.append, jitter=lambda a, b: 0)
    assert pauses == [1.5, 3.0, 6.0, 12.0]

    def refused():
        raise EndpointError("x", 404)

    with pytest.raises(EndpointError):
        with_retries(refused, sleep=pauses.append)


def test_call_is_below_nothing_that_repeats_it(spark, template):
    work = evaluation.requests(items(spark), [{"id": "m", "name": "m", "provider": "p", "temperature": 0, "max_tokens": 1, "seed": None}], "{stem}", "c")
    plan = evaluation.unfinished(work, work.where("item_id = 'x'"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "<=>" in plan and "Cartesian" not in plan


def test_stream(spark, tmp_path, template):
    from gradus.streaming.resume import evaluate_stream, item_stream

    folder = tmp_path / "in"
    items(spark, 3).write.json(str(folder))
    for _ in range(2):
        evaluate_stream(item_stream(spark, str(folder)), str(tmp_path / "cp"), ["one"], template, config=CONFIG, out_dir=str(tmp_path / "out"), mock=True).awaitTermination(60)
    assert logs.rows_of(logs.scan_log(spark, str(tmp_path / "out/results"), schemas.RESULTS)).select(F.countDistinct("item_id")).first()[0] == 3
