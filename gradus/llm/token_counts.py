"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import small_batches


def with_token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    Texts travel to Python in Arrow batches that are cut anew to about equal bytes; long texts are cut at
    boundaries where the model's pieces cannot cross, and only lengths come back.  Null texts count as
    empty, null ids stay null, repeated rows give repeated rows, an empty table an empty result; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def counts(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from .tokens import UnitCounter, by_bytes, worker

        counter = worker(UnitCounter, tokenizer_path)
        for batch in by_bytes(batches, "text"):
            texts = batch.column("text")
            n = counter.count(texts)
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
