"""The external call: one row in, one row out, with retries, throttling and errors as rows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from ..sources.providers import ROW_ERRORS, EndpointError, TransientFailure, client, http_responder

#: Tries a call gets, and the first pause in seconds, which doubles.
TRIES, FIRST_PAUSE, JITTER = 5, 1.5, 0.5
#: Key of a call, and the order in which duplicates of a key are tried.
KEY = ["item_id", "model", "level", "prompt_condition"]
STAGED = "raw_output string, input_tokens long, output_tokens long, ts string, status string, error_type string, error_message string"


def with_retries(call: Callable[[], dict], *, tries: int = TRIES, sleep=time.sleep, jitter=random.uniform) -> dict:
    """call() until it succeeds; transient endpoint errors are tried again after growing pauses, others raised at once."""
    for k in range(tries):
        try:
            return call()
        except EndpointError as e:
            if not e.transient:
                raise
            last = e
        if k + 1 < tries:
            sleep(FIRST_PAUSE * 2**k + jitter(0, JITTER))
    raise TransientFailure(f"{tries} tries failed: {last}") from last


def call_models(pending: DataFrame, responder: Callable[[str], Callable[[dict], dict]] = http_responder, *, pause: float = 0.0, parallel: int | None = None, sleep=time.sleep) -> DataFrame:
    """``pending`` (KEY, position, provider, prompt, temperature, max_tokens, seed and any other columns) with STAGED columns.

    Rows of one key meet in one task in order of position: a later one is only called if all earlier ones failed,
    else its status is 'skipped'.  ``parallel`` bounds the tasks and so the calls at a time.  ``responder`` gives
    a provider's callable, once per worker, provider and credential.  Errors of one call give status 'failed'; any other
    exception ends the job.  Write the result before using it: every evaluation calls the models anew.
    """
    columns = pending.columns
    dealt = pending.repartition(parallel, *KEY) if parallel else pending.repartition(*KEY)

    def run(frames):
        last, done = None, False
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                key = tuple(None if row[k] is None else str(row[k]) for k in KEY)
                if key != last:
                    last, done = key, False
                if done:
                    out.append((None, None, None, None, "skipped", None, None))
                    continue
                try:
                    respond = client(responder, row["provider"])
                    request = {k: row[k] for k in ("item_id", "model", "level", "prompt_condition", "prompt", "temperature")} | {"max_tokens": int(row["max_tokens"])}
                    if row["seed"] is not None and row["seed"] == row["seed"]:
                        request["seed"] = int(row["seed"])
                    answer = with_retries(lambda: respond(request), sleep=sleep)  # noqa: B023
                    if answer.get("text") is None:
                        raise TransientFailure(f"{row['provider']} gave no choice for {row['model']}")
                    out.append((answer["text"], answer.get("input_tokens") or 0, answer.get("output_tokens") or 0, datetime.now(timezone.utc).isoformat(), "run", None, None))
                    done = True
                    if pause:
                        sleep(pause)
                except ROW_ERRORS as e:
                    out.append((None, None, None, datetime.now(timezone.utc).isoformat(), "failed", type(e).__name__, str(e)))
            names = [x.split()[0] for x in STAGED.split(", ")]
            for name, values in zip(names, zip(*out) if out else [()] * len(names)):
                pdf[name] = list(values)
            for name in ("input_tokens", "output_tokens"):
                pdf[name] = pdf[name].astype("Int64")
            yield pdf[[*columns, *names]]

    schema = pending.schema
    for x in STAGED.split(", "):
        schema = schema.add(*x.split())
    return dealt.sortWithinPartitions(*KEY, "position").mapInPandas(run, schema)
