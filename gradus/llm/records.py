"""Token-id output: length-delimited binary records with masked checksums, and an offset index per file.

Format of a data file ``ids-*.rec``: an 8-byte header (``GRID``, version, id width, two zero bytes), then
per record: payload length (u64), masked CRC-32 of these 8 bytes (u32), payload, masked CRC-32 of the
payload (u32); all little-endian.  The payload is the ids at the header's width.  The mask rotates the
CRC right by 15 bits and adds 0xA282EAD8, so that a checksum of data holding checksums is not degenerate.
Its index ``ids-*.idx`` has 24 bytes per record: record id (i64), byte offset of the record in the data
file (u64), number of ids (u32), 1 if the id is not null (u32); a reader can thus fetch any record alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, Window, functions as F

from .store import Workspace, small_batches

HEADER, FRAME = "<4sBB2x", "<QI"
MAGIC, VERSION = b"GRID", 1
INDEX = [("id", "<i8"), ("offset", "<u8"), ("n", "<u4"), ("valid", "<u4")]
SHARDS = "first_id long, path string, records long, tokens long, bytes long, part int"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def read_record(handle, at: int | None = None) -> bytes | None:
    """The payload of the record there (or next), None at the end; ValueError where a checksum fails."""
    if at is not None:
        handle.seek(at)
    head = handle.read(struct.calcsize(FRAME))
    if not head:
        return None
    if len(head) < struct.calcsize(FRAME):
        raise ValueError("torn record header")
    size, crc = struct.unpack(FRAME, head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("record length fails its checksum")
    payload, tail = handle.read(size), handle.read(4)
    if len(payload) < size or len(tail) < 4 or struct.unpack("<I", tail)[0] != masked_crc(payload):
        raise ValueError("record payload fails its checksum")
    return payload


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, tokenizer_path: str, out_dir: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes the records in ascending id order; one row per file.

    Rows are range-partitioned by id, so files have disjoint, ascending id ranges and each is written
    record by record in its task.  Every attempt of a task writes files of its own name; the returned
    table, which is written once, lists the files of the attempts that count, so lost executors and
    speculative copies leave unlisted files at worst.  Null texts give the end id alone; a null id sorts
    first and is marked in the index; an empty table gives no files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import UnitEncoder, by_bytes, worker

        encoder = worker(UnitEncoder, tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        fs, root = _open(out_dir)
        part = TaskContext.get().partitionId()
        name, data, index, first, records, tokens, at = f"ids-{part:06d}-{uuid.uuid4().hex}", None, None, None, 0, 0, 0
        for batch in by_bytes(batches, "text"):
            if data is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                data, index = fs.open_output_stream(f"{root}/{name}.rec"), fs.open_output_stream(f"{root}/{name}.idx")
                data.write(struct.pack(HEADER, MAGIC, VERSION, encoder.width))
                at = struct.calcsize(HEADER)
                first = batch.column("doc_id")[0].as_py()
            rows = np.zeros(batch.num_rows, INDEX)
            for k, (doc, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")))):
                ids += end
                framed = frame(ids)
                data.write(framed)
                n = len(ids) // encoder.width
                rows[k] = (doc or 0, at, n, doc is not None)
                at += len(framed)
                tokens += n
            records += len(rows)
            index.write(rows.tobytes())
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((first, pa.int64()), (f"{out_dir}/{name}", pa.string()), (records, pa.int64()), (tokens, pa.int64()), (at, pa.int64()), (part, pa.int32()))],
                ["first_id", "path", "records", "tokens", "bytes", "part"],
            )

    order = ["doc_id", F.xxhash64("text")]  # the second key divides rows that share an id, null ones among them
    return source.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, SHARDS)


def read_records(shards: DataFrame) -> DataFrame:
    """Reads listed files back, checking every checksum: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all records before it; the running sum is over files (a row each), then
    within each file.  Files are dealt out evenly and read one record at a time.
    """
    spark = shards.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    dealt = based.select("path", "base").repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path")

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, at = _open(path)
                with fs.open_input_stream(f"{at}.idx", buffer_size=1 << 20) as idx, fs.open_input_stream(f"{at}.rec", buffer_size=1 << 20) as data:
                    magic, version, width = struct.unpack(HEADER, data.read(struct.calcsize(HEADER)))
                    if (magic, version) != (MAGIC, VERSION):
                        raise ValueError(f"{path}.rec is not a record file of this version")
                    start = base
                    while rows := idx.read(24 * 10_000):
                        rows, out = np.frombuffer(rows, INDEX), []
                        for row in rows:
                            ids = np.frombuffer(read_record(data), f"<u{width}")
                            if len(ids) != row["n"]:
                                raise ValueError(f"{path}: index and records differ")
                            out.append((int(row["id"]) if row["valid"] else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> DataFrame:
    """Writes the records to a fresh shared folder and returns what reading them back gives."""
    work = Workspace(docs.sparkSession, "records")
    shards = work.write(write_records(docs, tokenizer_path, work.path("data"), id_col=id_col, text_col=text_col, end_id=end_id), "shards")
    work.release_shuffles()
    return read_records(shards)
