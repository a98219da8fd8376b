"""Line dedup by distinct-site spread: lines that many sites share are boilerplate and go from every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import Workspace, small_batches

#: Log2 of the registers of a sketch; its error is about 1.6 % of large counts.
LG_K = 12
BLANK = " \t\n\x0b\x0c\r"


def line_hash(line: Column) -> Column:
    """128-bit digest of a line without the ASCII white space at its ends: it alone decides what is removed."""
    return F.unhex(F.md5(F.btrim(line, F.lit(BLANK))))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, site, line): the distinct hashes of a document's lines of at least that many words."""
    enough = lambda x: F.size(F.split(F.btrim(x, F.lit(BLANK)), "[\\x20\\x09-\\x0D]+", min_words)) >= min_words
    hashes = F.transform(F.filter(F.split("text", "\n"), enough), line_hash)
    return docs.select("doc_id", "site", F.explode(F.array_distinct(hashes)).alias("line"))


def _without_copies(source: DataFrame, lines: DataFrame, copies: DataFrame, min_words: int) -> DataFrame:
    """(line, site) of documents that are no copies; sites are hashes, so that their minimum is aggregated in place."""
    number = lambda df: df.withColumn("site", F.when(F.col("site").isNotNull(), F.xxhash64("site")))
    gone = copies.select(F.col("doc_id").alias("__gone"))
    known = number(lines.where("doc_id is not null")).join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").groupBy("doc_id", "line").agg(F.min("site").alias("site"))
    texts = number(source.where("doc_id is null")).groupBy("text").agg(F.first("doc_id").alias("doc_id"), F.min("site").alias("site"))
    return known.select("line", "site").union(_lines(texts, min_words).select("line", "site"))


def estimate_spread(lines: DataFrame, sites: int) -> DataFrame:
    """(line, sure) of the lines that may have ``sites`` distinct sites or more, from rows (site, line).

    A sketch per line merges by aggregation, map side first, so a line in a third of all documents is a sketch per
    task.  Lines whose estimate is over the threshold by more than a tenth (one at least) are sure; others within that
    of it have to be counted.
    """
    band = max(1.0, 0.1 * sites)
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("estimate"))
    return sketched.where(F.col("estimate") >= sites - band).select("line", (F.col("estimate") > sites + band).alias("sure"))


def remove_spread_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = 10, min_words: int = 3,
    copies: DataFrame | None = None, counts: tuple[str, str] | None = ("__n_lines", "__n_removed"),
) -> DataFrame:
    """``docs`` without its boilerplate lines; all columns stay, and two ``counts`` are added: lines and removed lines.

    A line is what stands between ``\\n``; lines are equal if they are so without the ASCII white space at their ends.  A line
    of at least ``min_words`` words that rows of at least ``sites`` distinct sites have is removed wherever
    it stands; other lines stay as they are, empty ones too.  Null texts stay null, with no lines; null
    sites count for no site; rows of a null id keep their lines; rows that repeat an id are treated alike; very long texts are
    cut and put together again in their task; a line on exactly ``sites`` sites (a tie) goes; an empty table stays empty.  The
    caller's columns travel in one struct, so their names clash with nothing, save that a column named as one of ``counts`` gives way.

    By default every row counts, so a text whose copies stand on that many sites loses its lines everywhere.  With ``copies``
    (doc_id), the documents that another one stands for, a document and its copies count for the one site of that other one:
    lines go only if unlike documents share them.  Rows of an id then count once, those of a null id once for each distinct text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "lines")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(site_col).cast("string").alias("site"))
    lines = work.write(_lines(source, min_words), "lines")
    evidence = lines if copies is None else work.write(_without_copies(source, lines, copies, min_words), "evidence")
    guessed = work.write(estimate_spread(evidence, sites), "guessed")
    work.release_shuffles()
    # ``key`` is computed, so the pairs are shuffled again after the join: Spark can then divide the join's partition of a hot line
    near = evidence.join(guessed.where("not sure").select("line"), "line").select(F.hex("line").alias("key"), "site").distinct()
    counted = near.groupBy("key").agg(F.count("site").alias("n")).where(F.col("n") >= sites).select(F.unhex("key").alias("line"))
    spread = guessed.where("sure").select("line").union(counted)
    bad = lines.where("doc_id is not null").join(spread, "line").groupBy(F.col("doc_id").alias("bad_id")).agg(F.collect_set("line").alias("bad"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(bad, F.col("id") == F.col("bad_id"), "left").select("row", "text", "bad")
    out_schema = marked.select("row").schema.add("text", "string").add("n_lines", "long").add("n_removed", "long")

    def clean(batches):
        import pyarrow as pa
        from hashlib import md5

        for batch in batches:
            kept, n, gone = [], [], []
            for text, bad in zip(batch.column("text").to_pylist(), batch.column("bad").to_pylist()):
                lines = [] if text is None else text.split("\n")
                n.append(len(lines))
                if bad and lines:
                    marks = set(bad)
                    left = [x for x in lines if md5(x.strip(BLANK).encode()).digest() not in marks]
                    gone.append(len(lines) - len(left))
                    text = "\n".join(left)
                else:
                    gone.append(0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_removed"])

    cleaned = marked.mapInArrow(clean, out_schema)
    fields = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in (counts or ())]
    return cleaned.select(*fields, *[F.col(x).alias(c) for c, x in zip(counts or (), ("n_lines", "n_removed"))])
