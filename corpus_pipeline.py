"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; the first four return the
columns of ``documents``, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradus.llm import decontaminate, line_spread, near_dups, packing, quality_rules
from gradus.llm.queries import tokenizer_path
from gradus.llm.store import Workspace, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's adaptive limits reject go.

    Null and empty texts fail the base rules and go; null ids, repeated rows and null languages or sources are judged like any other
    row; a rate that equals its limit stays; very long texts are measured whole; names of extra columns clash with nothing.
    """
    return quality_rules.filter_documents(docs)


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents linked at similarity 0.8 or more, directly or by others, with one of a smaller id."""
    return near_dups.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share go from every document; all documents stay.

    Near copies are one document here: else a text copied to many sites would lose its lines in all copies, the
    first one too, before the next stage can keep that.  Null texts stay null, empty ones empty; rows of a null id keep their lines;
    repeated rows are treated alike; extra columns stay, whatever their names.
    """
    cleaned = line_spread.remove_spread_lines(docs, copies=_copies(docs), counts=None)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at similarity 0.8 or more one stays, that of the smallest id.

    Null and empty texts and rows of a null id are linked with nothing and stay; rows that repeat an id stay or go together; extra
    columns stay, whatever their names.
    """
    gone = _copies(docs).select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an overlap with a benchmark item go.

    Null and empty texts hold nothing and stay; rows of one id, also of a null one, stay or go together; very long texts are searched
    whole; extra columns stay, whatever their names.
    """
    work = Workspace(spark, "decontaminate")
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), work)
    gone = found.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids; one row per piece.  Null and empty texts give their end id; null ids and repeated rows are packed
    like any other row; extra columns are not read."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontamination), ("packing", pack)]
#: SQL has neither the tokenizer nor the stages' sketches and components: the tests run it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
        work.release_shuffles()
    return docs
