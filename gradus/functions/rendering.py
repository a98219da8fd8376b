"""Prompts: options, single-pass substitution, hashes and mock answers, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from ..schemas import LETTERS


def format_options(options: Column) -> Column:
    """``A. text`` lines in the order A to D; absent letters are left out, other keys too; a null text reads None."""
    line = lambda k: F.when(F.map_contains_key(options, k), F.concat(F.lit(f"{k}. "), F.coalesce(F.try_element_at(options, F.lit(k)), F.lit("None"))))
    return F.array_join(F.array_compact(F.array(*[line(k) for k in LETTERS])), "\n")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """``template`` with each ``{name}`` of ``values`` replaced.  The template is cut on the driver and its parts are
    concatenated with the values, so what a value holds is never taken for a placeholder."""
    names = "|".join(re.escape(n) for n in values)
    parts = re.split(rf"\{{({names})\}}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def render_prompt(template: str, stem: Column, options: Column) -> Column:
    return render(template, {"stem": stem, "options": format_options(options)})


def prompt_hash(text: Column) -> Column:
    """The first 12 hex digits of the SHA-256 of the text with its line ends as ``\\n``."""
    return F.substring(F.sha2(F.regexp_replace(text, "\r\n?", "\n").cast("binary"), 256), 1, 12)


def bucket(key: Column, n: int) -> Column:
    """0 to n-1 by the first 32 bits of an MD5: the same in every engine."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def mock_answer(item_id: Column, model_id: Column, condition: Column) -> Column:
    """A letter that depends on item, model and condition only."""
    key = F.concat_ws("|", item_id, model_id, condition)
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), bucket(key, len(LETTERS)))


def mock_tokens(prompt: Column) -> Column:
    """A rough count of input tokens: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(prompt) / 4)).cast("long")
