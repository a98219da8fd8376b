"""The opN_ queries over the driver's tables, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .oracles import ORACLES  # noqa: F401 - read by __spark_entry__
from .store import read_table


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, as the installed package of vocabulary files gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import classifier

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    weights = classifier.fit(docs, labels.where(~held_out))
    scored = classifier.score(docs, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import encode_and_read_back

    return encode_and_read_back(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the md5 of the text that is left."""
    from .line_spread import remove_spread_lines

    cleaned = remove_spread_lines(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.md5("text").alias("kept_md5"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import with_token_counts

    return with_token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dups import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_report

    return quality_report(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_report

    report = contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return report.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs made from every conversation (the tables hold none); spans as text, for a plain comparison."""
    from .preferences import echo_pairs, format_preferences

    done = format_preferences(echo_pairs(read_table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return done.withColumns({"chosen_mask": spans(F.col("chosen_mask")), "rejected_mask": spans(F.col("rejected_mask"))})


def op8_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_token_records, op3_line_spread, op4_packing, op5_token_counts,
        op6_decontamination, op7_preferences, op8_minhash_near_dups, op9_substring_dedup, op10_quality_rules,
    )
}
