"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents' pieces."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, functions as F

from .store import Workspace, small_batches

#: Pieces in a group: enough for first-fit decreasing to fill bins well, few enough for one task.
GROUP_PIECES = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """A tournament tree: each inner node holds the most room of the bins below it, so the leftmost bin
    with room for a piece is found in log(bins) steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The leftmost bin with that room, which it takes there."""
        room, at = self.room, 1
        while at < self.leaves:
            at = 2 * at if room[2 * at] >= size else 2 * at + 1
        room[at] -= size
        leaf = at
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return leaf - self.leaves


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; ties keep the given order.  Sizes are 1 to ``capacity``."""
    tree, out = CapacityTree(len(sizes), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.place(sizes[i])
    return out


def _pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int | None) -> DataFrame:
    """Encodes each text, appends ``end_id`` and cuts it every ``length`` ids; ids stay in the task that made them."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import UnitEncoder, by_bytes, worker

        encoder = worker(UnitEncoder, tokenizer_path)
        end = [] if end_id is None else [end_id]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"]
        row = TaskContext.get().partitionId() << 40
        for batch in by_bytes(batches, "text"):
            rows = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                ids = np.append(np.frombuffer(raw, encoder.dtype).astype("<u4"), np.array(end, "<u4"))
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    row += 1
                    rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), row))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    return docs.mapInArrow(cut, PIECES + ", spread long")


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int | None = 1, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document of more than ``length`` ids is cut every ``length`` ids: whole pieces fill sequences of
    their own, and its rest is packed like a short document.  Descriptions of pieces, a few numbers each, are written to the shared
    folder; then they are dealt to as many groups of about ``group_pieces`` as there are, by a seeded hash of their place in that
    table, and each group runs first-fit decreasing by itself, so a task holds a bounded number of descriptions and never ids or
    texts, however often a row or an id is repeated and however long a text is.  Ties go by content, id and start.
    Sequence ids are unique over all groups; offsets in a sequence run from 0 without gaps.

    Null texts are empty: the end id alone is packed (nothing, if ``end_id`` is None).  Null ids and
    repeated rows are packed like any other row.  An empty table gives no rows; other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = work.write(_pieces(source, tokenizer_path, length, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("spread", F.lit(seed)), F.lit(groups)))

    def fill(key, rows):
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "start"], ascending=[False, True, True, True], kind="stable", na_position="first")
        sizes = rows["length"].tolist()
        bins = first_fit_decreasing(sizes, length)
        used: dict[int, int] = {}
        offsets = []
        for b, n in zip(bins, sizes):
            offsets.append(used.get(b, 0))
            used[b] = offsets[-1] + n
        return rows.drop(columns=["group", "spread"]).assign(sequence_id=[(int(key[0]) << 32) + b for b in bins], offset=offsets)

    return pieces.groupBy("group").applyInPandas(fill, PIECES + ", sequence_id long, offset long")
