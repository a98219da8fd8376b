"""Quality rules with adaptive thresholds: DataFrame functions only.

The quantile sketch is a log-linear histogram of non-negative integers: values below 2**(B+1) have a bucket
each, larger ones keep their leading B+1 bits, so a bucket is at most 2**-B of its value wide.  Buckets with counts
merge by adding, in any order and to the same result, so a groupBy builds the sketch of every language
and source with partial aggregation: no group meets in one task, whatever its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Workspace

#: Leading bits kept beyond the first: buckets at most 1/64 of their value wide.
SKETCH_BITS = 6

WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
#: The metrics that get adaptive limits; all are higher for worse texts.
METRICS = ("symbol_mille", "dup_line_mille", "repeat_mille", "word_len_cents")
#: The sizes that rates are taken of; sketched too.
SIZES = ("word_chars", "n_lines", "n_words")
#: (spread factor, allowance, its size, least size) by metric: a text is rejected above q50 + factor * (q50 - q25) +
#: allowance / max(q50 of the size, least size) of its language and source.  The spread below the median keeps bad rows, which are
#: high, from loosening the limit while they are under half of the group.  The allowance is what some events (16 symbols, 2 lines,
#: 54 words) make in a middling text of the group: most rates are 0, and a quantile of 0 must not reject for a single event.
LIMITS = {
    "symbol_mille": (8, 16_000, "word_chars", 300),
    "dup_line_mille": (8, 2_000, "n_lines", 5),
    "repeat_mille": (8, 54_000, "n_words", 75),
    "word_len_cents": (12, 0, "n_words", 50),
}
#: The most a rate can be.  Its limit stays below the middle of that and the median, so the rule can always reject.
MOST = {"symbol_mille": 1000, "dup_line_mille": 1000, "repeat_mille": 1000}

#: Rows of the group above that a group's limits are averaged with, and how many times those limits its own can be at most.
PRIOR_ROWS, PRIOR_TIMES = 100, 2


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda variable can't be inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more.  Windows are compared by a 64-bit hash; sorting puts equal
    ones side by side, so a text of n words costs n log n."""

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            same = lambda e, i, d: F.coalesce(F.get(pairs, i + F.lit(d))["h"] == e["h"], F.lit(False))
            at = F.array_sort(F.transform(F.filter(pairs, lambda e, i: same(e, i, -1) | same(e, i, 1)), lambda e: e["p"]))
            return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + F.lit(1)) - x), F.lit(3))), F.lit(0), lambda a, x: a + x))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, of_sorted))

    def of_words(w: Column) -> Column:
        triples = F.zip_with(w, F.zip_with(F.slice(w, F.lit(2), F.size(w)), F.slice(w, F.lit(3), F.size(w)), lambda b, c: F.when(c.isNotNull(), F.struct(b.alias("b"), c.alias("c")))), lambda a, t: F.when(t.isNotNull(), F.xxhash64(a, t["b"], t["c"])))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(F.slice(triples, F.lit(1), F.size(w) - 2), of_hashes))

    return _let(words, of_words).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of whole texts; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(whole, WORD_SPLIT), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, WORD_SPLIT, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words),
    }


def bucket(value: Column) -> Column:
    """The smallest value of the sketch bucket that holds ``value`` (a non-negative long)."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - (SKETCH_BITS + 1))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(rows: DataFrame, keys: list[str], metrics=METRICS) -> DataFrame:
    """(keys, metric, bucket, n): mergeable by adding n of equal buckets."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m"))
    return long.groupBy(*keys, F.col("m.metric").alias("metric"), bucket(F.col("m.value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """(keys, metric, n, one column for each point): the least bucket that reaches the share of the group's rows.  A group has a
    bounded number of buckets, so its window is small."""
    by = Window.partitionBy(*keys, "metric")
    ranked = sketches.withColumn("below", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by))
    return ranked.groupBy(*keys, "metric").agg(F.max("all").alias("n"), *[F.min(F.when(F.col("below") >= F.col("all") * p, F.col("bucket"))).alias(name) for name, p in points.items()])


def measure(docs: DataFrame) -> DataFrame:
    """docs with the base columns of ``text`` and the METRICS, whole-number rates; 0 where a text has no words."""
    rate = lambda a, b, unit: F.coalesce(F.floor(F.try_divide(F.col(a) * unit, F.col(b))), F.lit(0)).cast("long")
    return docs.withColumns(base_columns(F.col("text"))).withColumns({
        "symbol_mille": rate("n_symbols", "word_chars", 1000),
        "dup_line_mille": rate("n_dup_lines", "n_lines", 1000),
        "repeat_mille": rate("n_repeat_words", "n_words", 1000),
        "word_len_cents": rate("word_chars", "n_words", 100),
    })


def _limits_of(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, one limit column for each metric) by a group's own quantiles, from sketches of finer keys, which are merged."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    points = quantiles(merged, keys, {"q25": 0.25, "q50": 0.5})
    of = lambda name, m: F.max(F.when(F.col("metric") == m, F.col(name)))
    wide = points.groupBy(*keys).agg(
        F.max("n").alias("n"), *[of(q, m).alias(f"{q}_{m}") for q in ("q25", "q50") for m in METRICS], *[of("q50", m).alias(f"size_{m}") for m in SIZES]
    )
    own = []
    for m, (spread, allowance, size, least) in LIMITS.items():
        middle, low = F.col(f"q50_{m}"), F.col(f"q25_{m}")
        limit = middle + spread * (middle - low) + F.floor(F.lit(allowance) / F.greatest(F.col(f"size_{size}"), F.lit(least)))
        own.append((F.least(limit, F.floor((middle + MOST[m]) / 2)) if m in MOST else limit).cast("long").alias(m))
    return wide.select(*keys, "n", *own)


def limits(measured: DataFrame, keys: list[str], work: Workspace) -> DataFrame:
    """(keys, one limit column for each metric, named as it), from sketches over all rows.

    A group's limits are averaged with those of the group above it, (language, source) with the language's and that with the
    table's: n rows weigh n against PRIOR_ROWS, so small groups follow their relatives and large ones themselves, and no count
    of rows flips a rule.  A group in which bad rows prevail is held by at most PRIOR_TIMES the limits above it.
    """
    sketches = work.write(sketch(measured, keys, (*METRICS, *SIZES)), "sketches")
    top = _limits_of(sketches, []).first()
    above, out = {m: F.lit(top[m] if top else None).cast("long") for m in METRICS}, None
    for k in range(1, len(keys) + 1):
        own = _limits_of(sketches, keys[:k])
        if out is not None:
            parent = out.select(*[F.col(x).alias(f"above_{x}") for x in (*keys[: k - 1], *METRICS)])
            own = own.join(parent, [F.col(x).eqNullSafe(F.col(f"above_{x}")) for x in keys[: k - 1]])
            above = {m: F.col(f"above_{m}") for m in METRICS}
        total = {m: F.col("n") * F.col(m) + PRIOR_ROWS * above[m] for m in METRICS}
        out = own.select(*keys[:k], *[F.least(F.call_function("div", total[m], F.col("n") + PRIOR_ROWS), PRIOR_TIMES * above[m]).alias(m) for m in METRICS])
    return out


#: Groups up to which the limits are broadcast (five numbers each); their count is checked before, and more are joined by shuffling.
BROADCAST_GROUPS = 50_000


def judge(measured: DataFrame, keys: list[str], work: Workspace) -> DataFrame:
    """``measured`` with its limits (limit_ and the metric), base_failed and kept.

    ``measured`` is read twice, so pass a written table.  Keys are compared null-safe: null languages or
    sources form a group.  A row is kept if no base rule and no limit of its group rejects it.
    """
    found = limits(measured, keys, work)
    renamed = found.select(*[F.col(k).alias(f"of_{k}") for k in keys], *[F.col(m).alias(f"limit_{m}") for m in METRICS])
    if renamed.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        renamed = F.broadcast(renamed)
    on = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    within = F.lit(True)
    for m in METRICS:
        within = within & (F.col(m) <= F.col(f"limit_{m}"))
    joined = measured.join(renamed, on, "left").drop(*[f"of_{k}" for k in keys])
    return joined.withColumns({"base_failed": failed, "kept": ~failed & within})


def _measured(docs: DataFrame, text_col: str, keys: tuple[str, ...], carried: Column, work: Workspace) -> tuple[DataFrame, list[str]]:
    """(row, keys under names of their own, measures), written: what the caller's table has stays inside ``row``, so no name clashes."""
    names = [f"key{i}" for i in range(len(keys))]
    source = docs.select(carried.alias("row"), docs[text_col].alias("text"), *[docs[k].alias(n) for k, n in zip(keys, names)])
    return work.write(measure(source).drop("text"), "measured"), names


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, base columns, metrics, limit_ columns, base_failed, kept) of every row.

    Texts are read once; the measures, a few numbers a row, are written to the shared folder, sketched per
    group and joined with the group's limits.  Null and empty texts have no words and fail the base rule; very long texts are
    measured whole in their task; a rate that equals its limit is kept; null keys form a group; null ids and repeated rows stay; an
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    work = Workspace(docs.sparkSession, "quality")
    measured, names = _measured(docs, text_col, keys, F.struct(docs[id_col].alias("doc_id")), work)
    judged = judge(measured, names, work).drop(*names)
    return judged.select("row.doc_id", *[c for c in judged.columns if c != "row"])


def filter_documents(docs: DataFrame, *, text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns, whatever their names.

    The table is written once with its measures, so no text is shuffled or measured twice: the limits come from the measures, and
    the second pass only joins them.  Odd rows as in ``quality_report``.
    """
    work = Workspace(docs.sparkSession, "quality")
    measured, names = _measured(docs, text_col, keys, F.struct(*[docs[f"`{c}`"] for c in docs.columns]), work)
    return judge(measured, names, work).where("kept").select("row.*")
