"""Benchmark decontamination by spaced seeds.

A window of ``WINDOW`` words is divided into four blocks; each of the six masks keeps two blocks and ignores the
token positions of the others.  Two substitutions touch two blocks at most, so any two windows that differ
in at most two words agree under one mask: no such overlap is missed.  Items of fewer words are one window, which has fewer
substitutions and blocks.  The hashes of both sides are joined, and every pair of windows that shares one is verified word by word.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from .store import Workspace, small_batches

WINDOW, SUBSTITUTIONS = 13, 2
#: Items of fewer words are found only where they are the whole document: such phrases stand in many clean texts.
PHRASE = 5
#: (start, length) of the four blocks of a full window.
BLOCKS = ((0, 4), (4, 3), (7, 3), (10, 3))
MASKS = tuple(combinations(range(4), 2))
#: Benchmark seeds (six a word) up to which the benchmark's side of the joins is broadcast, about 20 MB; more are joined by shuffling.
BROADCAST_SEEDS = 300_000
#: Bits of the filter for each seed, and log2 of its bits at most (64 MB): beyond that more texts pass it, and none is lost.
BITS_EACH, MOST_BITS, PROBES = 32, 29, 4

_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def allowed(length: int) -> int:
    """Substitutions in a window of that many words."""
    return SUBSTITUTIONS * length // WINDOW


def blocks_of(length: int):
    """(blocks, masks) of a window: with s substitutions in a short one, one of s + 1 blocks stays whole."""
    if length == WINDOW:
        return BLOCKS, MASKS
    parts = allowed(length) + 1
    cuts = [length * k // parts for k in range(parts + 1)]
    return tuple((a, b - a) for a, b in zip(cuts, cuts[1:])), tuple((k,) for k in range(parts))


def split(text: str | None) -> list[bytes]:
    """The lower-cased words; ASCII characters that are neither letters nor digits divide words."""
    return (text or "").lower().encode().translate(_TABLE).split()


def hashed(words: list[bytes]):
    import numpy as np
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _mix(a, b):
    import numpy as np

    h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _runs(w, n: int):
    import numpy as np

    count = max(0, len(w) - n + 1)
    h = np.full(count, n, np.uint64)
    for i in range(n):
        h = _mix(h, w[i : i + count])
    return h


def seeds(w, length: int = WINDOW):
    """For each mask, the hash of the kept words of every window of ``length`` words."""
    import numpy as np

    count = len(w) - length + 1
    if count < 1:
        return []
    blocks, masks = blocks_of(length)
    by = {n: _runs(w, n) for n in {n for _, n in blocks}}
    out = []
    for k, mask in enumerate(masks):
        h = np.full(count, 64 * length + k, np.uint64)
        for b in mask:
            at, n = blocks[b]
            h = _mix(h, by[n][at : at + count])
        out.append(h)
    return out


def _joined(texts):
    """(hashes of the words of all texts, first word and number of words of each)."""
    import numpy as np

    words, sizes = [], []
    for text in texts:
        found = split(text.as_py())
        words += found
        sizes.append(len(found))
    sizes = np.array(sizes, np.int64)
    return hashed(words), np.cumsum(sizes) - sizes, sizes


def _lists(rows):
    """An Arrow list array of the rows of a matrix."""
    import numpy as np
    import pyarrow as pa

    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1).view(np.int64)))


def _items(benchmark: DataFrame) -> DataFrame:
    """(key, item_id, place, words, seeds): every window of every item."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for key, item, text in zip(batch.column("key").to_pylist(), batch.column("item_id").to_pylist(), batch.column("text")):
                w = hashed(split(text.as_py()))
                if not len(w):
                    continue
                length = min(len(w), WINDOW)
                windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(w, length))
                n = len(windows)
                columns = [pa.array(np.full(n, key)), pa.array(np.full(n, item)), pa.array(np.arange(n)), _lists(windows), _lists(np.stack(seeds(w, length), axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "item_id", "place", "words", "seeds"])

    return benchmark.mapInArrow(run, "key long, item_id long, place long, words array<long>, seeds array<long>")


class SeedFilter:
    """A Bloom filter of seeds: no seed it was made of is ever missed."""

    def __init__(self, count: int):
        self.lg = min(MOST_BITS, max(12, (BITS_EACH * count - 1).bit_length()))

    def places(self, h, probe: int):
        import numpy as np

        if probe:
            h = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 + 2 * probe * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF | 1)
        return h >> np.uint64(64 - self.lg)

    def fill(self, seed_rows: DataFrame) -> SeedFilter:
        """Sets the bits of (seed): each task makes 64-bit words of the filter, which are merged by aggregation."""
        place = self.places

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                h = batch.column("seed").to_numpy().view(np.uint64)
                at = np.unique(np.concatenate([place(h, k) for k in range(PROBES)]))
                words = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first := np.unique(at >> np.uint64(6), return_index=True)[1]) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array((at[first] >> np.uint64(6)).astype(np.int64) if len(at) else at.astype(np.int64)), pa.array(words.view(np.int64))], ["at", "word"])

        import numpy as np

        found = seed_rows.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        self.words = np.zeros(1 << max(0, self.lg - 6), np.uint64)
        self.words[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
        return self

    def maybe(self, h):
        """Indices of the hashes that may be seeds."""
        import numpy as np

        left = np.arange(len(h))
        for k in range(PROBES):
            at = self.places(h[left], k)
            left = left[(self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        return left


def _hits(docs: DataFrame, known, lengths: list[int]) -> DataFrame:
    """(seed, doc_id, place, window) of the windows whose seed passes the filter.  The texts of a batch are hashed as one
    sequence of words; windows that cross from one text to the next don't count."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            w, begins, sizes = _joined(batch.column("text"))
            ids, of = batch.column("doc_id"), np.repeat(np.arange(len(sizes)), sizes)
            for length in lengths:
                if len(w) < length:
                    continue
                count = len(w) - length + 1
                owner = of[:count]
                fits = np.arange(count) - begins[owner] + length <= sizes[owner]
                if length < PHRASE:
                    fits &= sizes[owner] == length
                windows = np.lib.stride_tricks.sliding_window_view(w, length)
                for h in seeds(w, length):
                    at = known.value.maybe(h)
                    at = at[fits[at]]
                    columns = [pa.array(h[at].view(np.int64)), ids.take(pa.array(owner[at])), pa.array(at - begins[owner[at]]), _lists(np.ascontiguousarray(windows[at]))]
                    yield pa.RecordBatch.from_arrays(columns, ["seed", "doc_id", "place", "window"])

    return docs.mapInArrow(run, "seed long, doc_id long, place long, window array<long>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, work: Workspace, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, words) for every document that holds an overlap with a benchmark item.

    An overlap is a window of 13 words of both that differs in at most 2 words at the same places; an item of 7 to 12 words has to
    stand in the document as a whole but for 1 word, one of 5 or 6 words unchanged; an item of 1 to 4 words has to be all
    the words of the document.  ``words`` counts the item's words that overlaps cover at one shift of the texts, the most of all shifts.

    The corpus is read once, whatever the size of the benchmark: windows whose seeds pass a filter of the benchmark's seeds (at
    most 64 MB) are joined with these by hash.  The benchmark's side is broadcast up to BROADCAST_SEEDS; beyond, both sides are
    shuffled, and Spark's adaptive joins divide the partition of a seed that many documents have.

    Null and empty texts hold nothing; null items and items without words are ignored; repeated rows count once, and rows of one
    id, also of a null one, are one document; very long texts are hashed whole; of equal overlaps (ties) every item is
    reported; empty tables give no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    windows = work.write(_items(items.withColumn("key", F.xxhash64("item_id", "text"))), "windows")
    seed_rows = windows.select(F.explode("seeds").alias("seed"), "key", F.col("place").alias("at"))
    counted = windows.agg(F.sum(F.size("seeds")).alias("n"), F.collect_set(F.size("words")).alias("lengths")).first()
    known = spark.sparkContext.broadcast(SeedFilter(counted["n"] or 0).fill(seed_rows.select("seed")))
    hits = _hits(source, known, sorted(counted["lengths"]))
    words = windows.select("key", F.col("place").alias("at"), "item_id", "words")
    small = F.broadcast if (counted["n"] or 0) <= BROADCAST_SEEDS else lambda df: df
    pairs = hits.join(small(seed_rows), "seed").join(small(words), ["key", "at"])
    size = F.size("words")
    same = F.size(F.filter(F.zip_with("window", "words", lambda a, b: a == b), lambda x: x))
    good = pairs.where((F.size("window") == size) & (same >= size - F.floor(size * SUBSTITUTIONS / WINDOW)))
    by_shift = good.groupBy("doc_id", "item_id", "key", (F.col("place") - F.col("at")).alias("shift")).agg(F.array_sort(F.collect_set("at")).alias("at"), F.max(size).alias("length"))
    steps = F.transform("at", lambda x, i: F.coalesce(F.least(F.get("at", i + F.lit(1)) - x, F.col("length")), F.col("length")))
    covered = by_shift.withColumn("words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))
    return work.write(covered.groupBy("doc_id", "item_id").agg(F.max("words").alias("words")), "found")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids, words) of every row; item_ids in ascending order, empty for clean documents."""
    found = find_contamination(docs, benchmark, Workspace(docs.sparkSession, "decontaminate"))
    by_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("words").alias("words"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(by_doc.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("words", F.lit(0)).alias("words"))
