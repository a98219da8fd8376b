import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm.queries import tokenizer_path
from gradus.llm.tokens import UnitCounter, UnitEncoder

PARTS = ["a", "B", " ", " ", "\n", "\t", "é", "1", ".", "'s", "\xa0", "　", "\x1c", "\x85", "<|endoftext|>", "▁", "中", "😀", "the", ",", "\x00", "Ⅷ", "<s>"]


def texts(n=4000):
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["x" * 5000, "ab " * 3000, " " * 300]


def test_units_equal_whole_texts():
    e, t = UnitEncoder(tokenizer_path("byte_bpe_50k.json")), texts()
    want = [x.ids for x in e.tokenizer.encode_batch(t, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(t)] == want
    assert e.encode([None, ""]) == [b"", b""] and e.encode([]) == []


def test_other_tokenizers_are_encoded_whole():
    e, t = UnitEncoder(tokenizer_path("word_bpe_49k.json")), texts(300)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(t)] == [x.ids for x in e.tokenizer.encode_batch(t, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts(name):
    c, t = UnitCounter(tokenizer_path(name)), texts()
    whole = c._model.encode(t) if name.endswith(".model") else [x.ids for x in c._encoder.tokenizer.encode_batch(t, add_special_tokens=False)]
    assert c.count(t) == [len(x) for x in whole] and c.count([None, ""]) == [0, 0]


def odd_docs(spark):
    rows = [(5, "b c"), (None, "no id"), (2, None), (9, ""), (5, "b c"), (7, "word " * 9000), (-1, "x\ny  z <|endoftext|>")]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, n_tokens string, start int, class string"), rows


def test_token_counts_query(spark):
    from gradus.llm.token_counts import with_token_counts

    docs, rows = odd_docs(spark)
    path = tokenizer_path("piece_bpe_32k.model")
    c = UnitCounter(path)
    got = with_token_counts(docs, path, limit=3).collect()
    want = [(i, len((t or "").encode()), n := len(c._model.encode(t or "")), n > 3) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert with_token_counts(docs.limit(0), path).count() == 0


def test_records_round_trip(spark):
    from gradus.llm.records import encode_and_read_back

    docs, rows = odd_docs(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    e = UnitEncoder(path)
    got = sorted((tuple(r) for r in encode_and_read_back(docs, path).collect()), key=lambda r: r[1])
    ids = [np.append(np.frombuffer(x, e.dtype), 0).astype("<u4") for x in e.encode([t for _, t in rows])]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    start, want = 0, []
    for i in order:
        want.append((rows[i][0], start, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        start += len(ids[i])
    assert [g[0] for g in got] == [w[0] for w in want] and got == want
    assert encode_and_read_back(docs.limit(0), path).count() == 0


def test_frames_detect_damage():
    from gradus.llm.records import frame, read_record

    data = frame(b"one") + frame(b"") + frame(b"three")
    handle = io.BytesIO(data)
    assert [read_record(handle) for _ in range(4)] == [b"one", b"", b"three", None]
    assert read_record(handle, at=len(frame(b"one")) + len(frame(b""))) == b"three"
    for at in range(len(frame(b"one"))):
        broken = bytearray(frame(b"one"))
        broken[at] ^= 1
        with pytest.raises(ValueError):
            read_record(io.BytesIO(bytes(broken)))
    with pytest.raises(ValueError):
        read_record(io.BytesIO(data[:5]))


def test_index_allows_single_reads(spark, tmp_path):
    from gradus.llm import records

    docs, _ = odd_docs(spark)
    shards = records.write_records(docs.where("doc_id > 0"), tokenizer_path("byte_bpe_50k.json"), f"file://{tmp_path}/out").collect()
    for s in shards:
        base = s["path"].removeprefix("file://")
        rows = np.fromfile(base + ".idx", records.INDEX)
        with open(base + ".rec", "rb") as f:
            for row in reversed(rows):
                assert len(records.read_record(f, int(row["offset"]))) == 2 * row["n"]


def test_packing(spark):
    from gradus.llm.packing import pack

    docs, rows = odd_docs(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    e = UnitEncoder(path)
    got = pack(docs, path, group_pieces=3).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    pieces = sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples())
    want = []
    for (i, _), raw in zip(rows, e.encode([t for _, t in rows])):
        ids = np.append(np.frombuffer(raw, e.dtype), 1).astype("<u4")
        want += [(-1 if i is None else i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    assert pieces == sorted(want)
    assert pack(docs.limit(0), path).count() == 0


def test_groups_of_pieces_are_bounded(spark):
    from gradus.llm.packing import pack

    docs = spark.createDataFrame([(7, "the same row")] * 3000 + [(8, "long text " * 30_000)], "doc_id long, text string").repartition(3)
    got = pack(docs, tokenizer_path("byte_bpe_50k.json"), group_pieces=500)
    sizes = [r["n"] for r in got.groupBy(F.shiftright("sequence_id", 32).alias("group")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) < 700


def test_queries_equal_the_library_on_all_documents(spark, sf_dir):
    from tokenizers import Tokenizer
    import sentencepiece

    from gradus.llm import queries

    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    ids = {i: e.ids for (i, _), e in zip(docs, Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode_batch([t for _, t in docs], add_special_tokens=False))}
    crc = lambda xs: zlib.crc32(np.array(xs, "<u4").tobytes())
    start, want = 0, []
    for i, _ in docs:
        own = [*ids[i], 0]
        want.append((i, start, len(own), crc(own)))
        start += len(own)
    assert sorted(tuple(r)[:4] for r in queries.op2_token_records(spark, sf_dir).collect()) == want
    pieces = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in queries.op4_packing(spark, sf_dir).collect())
    whole = {i: [*x, 1] for i, x in ids.items()}
    assert pieces == sorted((i, at, len(x[at : at + 2048]), crc(x[at : at + 2048]), len(x)) for i, x in whole.items() for at in range(0, len(x), 2048))
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    counts = {i: len(x) for (i, _), x in zip(docs, model.encode([t for _, t in docs]))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op5_token_counts(spark, sf_dir).collect()} == {i: (len(t.encode()), counts[i], counts[i] > 4096) for i, t in docs}


def test_first_fit_decreasing_takes_the_leftmost_bin():
    from gradus.llm.packing import first_fit_decreasing

    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 40))]
        room, want = [20] * len(sizes), [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            want[i] = next(b for b, r in enumerate(room) if r >= sizes[i])
            room[want[i]] -= sizes[i]
        assert first_fit_decreasing(sizes, 20) == want


def test_padding_is_little(spark, sf_dir):
    from gradus.llm.queries import op4_packing

    sizes = op4_packing(spark, sf_dir).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in sizes) / (2048 * len(sizes)) > 0.97
