"""Preference formatting: DataFrame functions only.

Chosen and rejected conversations of a pair are cut at their longest common prefix of turns; the prefix is rendered
once, as the prompt, and each side's remaining turns become a completion whose assistant spans are unmasked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN = ("<|", "|>\n", "<|end|>\n")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN[0]), role, F.lit(TURN[1]), text, F.lit(TURN[2]))


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair, from rows (pair_id, chosen boolean, turn, role, text).

    Columns: pair_id, prefix_turns, prompt, chosen, rejected (rendered texts) and chosen_mask, rejected_mask: arrays of
    [start, end) character spans of the completion that are trained on, those of assistant turns.  The
    completions leave the prompt out, which is rendered once and masked as a whole.

    Turns are ranked by (turn, role, text) in their conversation, so gaps and ties in ``turn`` do not matter;
    the prefix ends before the first rank at which the sides differ or one has no turn.  Null roles and
    texts equal each other and are rendered as empty; turns of a null pair or null side are left out; a pair with one side
    gets that side as its completion, an empty prompt and null for the other.  Equal rows count as separate turns.
    Common turns are found by aggregation, not by comparing collected conversations.
    """
    side = F.when(F.col("chosen"), 1).otherwise(2)
    rows = turns.where("pair_id is not null and chosen is not null").select("pair_id", "chosen", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id", "chosen").orderBy("turn", "role", "text")))
    at = ranked.groupBy("pair_id", "rank").agg(
        F.sum(side).alias("sides"),
        *[F.max(F.when(F.col("chosen") == c, F.col(k))).alias(f"{k}_{n}") for c, n in ((True, "c"), (False, "r")) for k in ("role", "text")],
    )
    same = (F.col("sides") == 3) & (F.col("role_c") == F.col("role_r")) & (F.col("text_c") == F.col("text_r"))
    by = Window.partitionBy("pair_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    common = F.min(F.when(same, 1).otherwise(0)).over(by) == 1
    cut = at.withColumn("common", common)
    has = lambda n: F.col(f"role_{n}").isNotNull()
    part = lambda n, keep: F.array_sort(F.collect_list(F.when(keep, F.struct("rank", F.col(f"role_{n}").alias("role"), F.col(f"text_{n}").alias("text")))))
    grouped = cut.groupBy("pair_id").agg(
        F.count_if("common").alias("prefix_turns"),
        part("c", F.col("common")).alias("p"),
        part("c", ~F.col("common") & has("c")).alias("c"),
        part("r", ~F.col("common") & has("r")).alias("r"),
        F.max(has("c")).alias("has_c"),
        F.max(has("r")).alias("has_r"),
    )
    text = lambda xs: F.array_join(F.transform(xs, lambda x: _rendered(x["role"], x["text"])), "")

    def mask(xs: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["role"]) + len(TURN[0]) + len(TURN[1])
            end = start + F.length(x["text"]) + len(TURN[2])
            span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
            return F.struct(end.cast("long").alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(xs, zero, step, lambda acc: acc["spans"])

    return grouped.select(
        "pair_id", "prefix_turns", text(F.col("p")).alias("prompt"),
        F.when(F.col("has_c"), text(F.col("c"))).alias("chosen"), F.when(F.col("has_r"), text(F.col("r"))).alias("rejected"),
        F.when(F.col("has_c"), mask(F.col("c"))).alias("chosen_mask"), F.when(F.col("has_r"), mask(F.col("r"))).alias("rejected_mask"),
    )


def echo_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: each one is the chosen side; its rejected twin repeats the text of the last
    turn before it instead of the last assistant turn, and ends there.  Conversations without an assistant turn after
    another turn give no pair."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where("conv_id is not null").withColumn("before", F.lag("text").over(by)).withColumn("place", F.row_number().over(by))
    last = F.max(F.when((F.col("role") == "assistant") & F.col("before").isNotNull(), F.col("place"))).over(Window.partitionBy("conv_id"))
    found = rows.withColumn("last", last).where("last is not null")
    sides = F.array(F.struct(F.lit(True).alias("chosen"), F.col("text").alias("text")), F.struct(F.lit(False).alias("chosen"), F.when(F.col("place") == F.col("last"), F.col("before")).otherwise(F.col("text")).alias("text")))
    both = found.select(F.col("conv_id").alias("pair_id"), F.col("place").alias("turn"), "role", "last", F.explode(sides).alias("s"))
    return both.where(F.col("s.chosen") | (F.col("turn") <= F.col("last"))).select("pair_id", F.col("s.chosen").alias("chosen"), "turn", "role", F.col("s.text").alias("text"))
