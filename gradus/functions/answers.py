"""Recovering an answer letter from raw model output, as a Column expression.

NULL means that no letter, or more than one, was found at the first stage that found any.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..schemas import LETTERS

#: Java's Unicode white space, and the four separators that Python strips besides.
_SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def _char_class(letters: list[str]) -> str:
    single = sorted(x for x in letters if len(x) == 1)
    return "[" + "".join("\\" + x if not x.isalnum() else x for x in single) + "]"


def parse_answer(raw: Column, valid_letters: Iterable[str] = LETTERS) -> Column:
    """The answer letter in ``raw``, or NULL.

    Stage 1: all of it is a letter of either case, white space and trailing periods aside.  Stage 2, in this
    order: after the word "answer", in parentheses (upper case only), in double asterisks.  Stage 3: an
    upper-case letter standing alone.  The first pattern that finds any valid letter decides: one distinct
    letter is the answer, several are ambiguous.  The patterns are literals, so the whole parse stays in the JVM.
    """
    letters = sorted(set(valid_letters))
    valid = F.array(*[F.lit(x) for x in letters])
    text = strip(raw)
    whole = F.upper(strip(F.regexp_replace(text, r"\.+$", "")))
    one = _char_class(letters)
    searches = [
        (rf"(?iuU)ANSWER{_SPACE}*[:\-]?{_SPACE}*\(?({one})\)?\b", True),
        (rf"(?U)\(({one})\)", False),
        (rf"(?iuU)\*\*({one})\*\*", True),
        (rf"(?U)\b({one})\b", False),
    ]
    answer = F.lit(None).cast("string")
    for pattern, fold in reversed(searches):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        found = F.transform(found, F.upper) if fold else found
        distinct = F.array_intersect(F.array_distinct(found), valid)
        answer = F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).when(F.size(distinct) > 1, F.lit(None)).otherwise(answer)
    return F.when(F.length(text) == 0, F.lit(None)).when(whole.isin(letters), whole).otherwise(answer)


def is_correct(predicted: Column, gold: Column) -> Column:
    """True, false, or NULL where nothing was parsed: unparseable is not wrong."""
    return predicted == gold
