"""Quality classifier: logistic regression on hashed word 1- and 2-grams, trained with follow-the-regularised-leader
updates (FTRL-proximal) and scored as sparse dot products.

Words are lower-cased; ASCII punctuation marks are words of their own, all digits are written as 0, and a word that repeats one of
the two before it is written as one repeat mark, so that n-grams of marks, numbers and repetitions are shared by all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .store import small_batches


@dataclass(frozen=True)
class FtrlConfig:
    """``max_rows`` bounds the labelled rows that the fit reads (a seeded hash of the id chooses them when
    there are more); of over ``shard_rows`` rows or ``shard_bytes`` of text, models trained on disjoint shards are averaged.
    Both labels weigh alike in training, whatever their shares, so a score of 0.5 is even evidence."""

    bits: int = 18
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    epochs: int = 8
    max_rows: int = 20_000
    shard_rows: int = 5_000
    shard_bytes: int = 64_000_000
    seed: int = 11


_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_MARKS = [bytes([c]) for c in range(33, 127) if not chr(c).isalnum()]


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words with their digits as 0, and punctuation marks."""
    raw = (text or "").lower().encode().translate(_DIGITS)
    for mark in _MARKS:
        if mark in raw:
            raw = raw.replace(mark, b" " + mark + b" ")
    return raw.split()


def features(text: str | None, bits: int):
    """(indices, values) of one text: index 0 is the bias; words and word pairs of the whole text are hashed, the pair
    orders kept; values are log(1 + count), scaled to unit length, so long and short texts weigh alike."""
    import numpy as np
    from zlib import crc32

    words = np.fromiter(map(crc32, tokens(text)), np.uint64)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[2:] |= words[2:] == words[:-2]
    words = np.where(again, np.uint64(REPEAT), words)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    index, count = np.unique(np.concatenate([words * mix >> shift, (words[:-1] * mix + words[1:]) * mix >> shift]), return_counts=True)
    values = np.log1p(count)
    norm = float(np.sqrt((values * values).sum())) or 1.0
    return np.concatenate([[0], index.astype(np.int64) + 1]).astype(np.int32), np.concatenate([[1.0], values / norm]).astype(np.float32)


#: What stands for a word that repeats one of the two before it.
REPEAT = 1


def _train(texts, labels, weights, config: FtrlConfig, order):
    import numpy as np

    size = (1 << config.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = [features(t, config.bits) for t in texts]

    def solved(z, n):
        return np.where(np.abs(z) <= config.l1, 0.0, -(z - np.sign(z) * config.l1) / ((config.beta + np.sqrt(n)) / config.alpha + config.l2))

    for epoch in range(config.epochs):
        for i in order(len(rows), epoch):
            index, x = rows[i]  # each index once
            zi, ni = z[index], n[index]
            w = solved(zi, ni)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - labels[i]) * weights[i] * x
            z[index] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / config.alpha * w
            n[index] += g * g
    return solved(z, n)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", config: FtrlConfig = FtrlConfig()):
    """The weights as a numpy array of fixed size (about 1 MB), from the texts of ``docs`` whose ids ``labels`` marks 0 or 1.

    Label rows with a null id or label are left out, and of several for one id the smallest label counts; of
    more than ``max_rows`` labelled ids a seeded hash of the id keeps about that many, so the label side of
    the join has a proven bound and is broadcast: no text is shuffled but those of the sample.  Each shard is
    a group of bounded size trained in one task, in an order fixed by the hash, so the weights do not depend
    on partitioning; the driver averages the shards' arrays, which are few as the sample is bounded.  Rows that repeat an id are
    further examples of its label; null and empty texts teach the bias alone; ties in the order go by id and text; very long texts
    are hashed whole.  Without labelled rows all weights are 0.  Other columns, whatever their names, are not read.
    """
    import numpy as np

    small_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    shares = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    place = F.pmod(F.xxhash64("id", F.lit(config.seed)), F.lit(1 << 30))
    if total > config.max_rows:
        marked = marked.where(place < int((1 << 30) * config.max_rows / total))
    even = F.lit(0.0)
    for label, n in shares.items():
        even = F.when(F.col("label") == label, total / (len(shares) * n)).otherwise(even)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marked), "id").withColumn("weight", even)
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, found["rows"] // config.shard_rows, (found["bytes"] or 0) // config.shard_bytes)
    shard = F.pmod(F.xxhash64("id", "text", F.lit(config.seed + 1)), F.lit(shards))

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["place", "id", "text"], na_position="first")
        order = lambda m, epoch: np.random.default_rng((config.seed, epoch)).permutation(m)
        w = _train(pdf["text"].tolist(), pdf["label"].to_numpy(), pdf["weight"].to_numpy(), config, order)
        return pd.DataFrame({"rows": [len(pdf)], "w": [w.astype("<f4").tobytes()]})

    parts = rows.select("id", "text", "label", "weight", place.alias("place"), shard.alias("shard")).groupBy("shard").applyInPandas(one, "rows long, w binary").collect()
    if not parts:
        return np.zeros((1 << config.bits) + 1, "<f4")
    return np.average([np.frombuffer(p["w"], "<f4") for p in parts], axis=0, weights=[p["rows"] for p in parts]).astype("<f4")


def score(docs: DataFrame, weights, *, id_col: str = "doc_id", text_col: str = "text", config: FtrlConfig = FtrlConfig()) -> DataFrame:
    """(doc_id, score) of every row: the sparse dot product of its whole text's features with the weights.

    Null and empty texts get the score of the bias; null ids stay; repeated rows give equal scores; very long texts are scored
    whole; an empty table gives no rows; other columns, whatever their names, are not read.  The broadcast weights have a fixed size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            w, out = shared.value, []
            for text in batch.column("text"):
                index, x = features(text.as_py(), config.bits)
                out.append(1.0 / (1.0 + float(np.exp(-np.clip(w[index] @ x, -35, 35)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double")
