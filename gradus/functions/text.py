"""Text measures for rewritten items."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fk_grade(text: Column) -> Column:
    """Flesch-Kincaid grade by the published formula; NULL without words.

    Words are runs of letters, sentences end in ``.``, ``!`` or ``?`` (one at least), and syllables are counted as groups of
    vowels, one at least a word, so scores differ a little from those of dictionary-based tools.
    """
    low = F.lower(text)
    words = F.regexp_count(low, F.lit(r"\p{L}+"))
    sentences = F.greatest(F.lit(1), F.regexp_count(low, F.lit(r"[.!?]+")))
    vowels = F.regexp_count(low, F.lit(r"[aeiouyáéíóúàèìòùâêîôûäëïöü]+"))
    syllables = F.greatest(words, vowels)
    return F.when(words > 0, F.lit(0.39) * words / sentences + F.lit(11.8) * syllables / words - F.lit(15.59))


def lost_numbers(original: Column, rewrite: Column) -> Column:
    """Numbers of the original that the rewrite does not have, in order and once each."""
    numbers = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.array_except(numbers(original), numbers(rewrite))


def rewrite_levels(raw: Column) -> Column:
    """(level_b, level_c) of a rewriter's JSON answer; NULL fields where it is malformed."""
    return F.from_json(raw, "level_b string, level_c string")
