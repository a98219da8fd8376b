import random
import re
from collections import defaultdict

import duckdb
import numpy as np

import corpus_pipeline
from gradus.llm.oracles import ORACLES
from gradus.llm.queries import tokenizer_path
from gradus.llm.tokens import UnitEncoder

from .test_dedup import shingles
from .test_filters import brute, item_words


def overlaps(w, m):
    """Whether a window of 13 words of both differs in at most 2 words; shifts with 11 equal words are tried."""
    places, shifts = defaultdict(list), defaultdict(int)
    for q, x in enumerate(m):
        places[x].append(q)
    for p, x in enumerate(w):
        for q in places.get(x, ()):
            shifts[p - q] += 1
    for shift in (d for d, n in shifts.items() if n >= 11):
        for q in range(max(0, -shift), min(len(m), len(w) - shift) - 12):
            if sum(m[q + k] == w[q + shift + k] for k in range(13)) >= 11:
                return True
    return False


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns

    kept = {r["doc_id"] for r in seen["quality_rules"]}
    base = {i: brute(t) for i, (t, _) in texts.items()}
    failed = {i for i, (n, _, _, _, rep) in base.items() if n < 50 or 100 * rep > 50 * n}
    verdicts = duckdb.connect()
    verdicts.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert not kept & failed and kept == {r[0] for r in verdicts.execute(f"select doc_id from ({ORACLES['op10_quality_rules']}) where kept").fetchall()}

    at = defaultdict(set)
    for r in seen["quality_rules"]:
        for x in r["text"].split("\n"):
            if len(x.split()) >= 3:
                at[x.strip()].add(r["source"])
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if len(at.get(x.strip(), ())) < 10) for r in seen["quality_rules"]}
    assert {r["doc_id"]: r["text"] for r in seen["line_dedup"]} == want and all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"])

    sets, stay = {i: shingles(t) for i, t in want.items()}, set(want)
    root = {i: i for i in sets}
    ids = sorted(i for i in sets if sets[i])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (common := len(sets[a] & sets[b])) and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                root[max(find(a), find(b))] = min(find(a), find(b))
    stay = {i for i in sets if find(i) == i}
    assert {r["doc_id"] for r in seen["near_dedup"]} == stay

    items = [item_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in seen["decontamination"]}
    assert clean == {i for i in stay if not any(overlaps(item_words(want[i]), m) for m in items)}

    encoder = UnitEncoder(tokenizer_path("byte_bpe_50k.json"))
    got = defaultdict(int)
    for r in seen["packing"]:
        got[r["doc_id"]] += r["length"]
    assert got == {i: len(np.frombuffer(encoder.encode([want[i]])[0], encoder.dtype)) + 1 for i in clean}


def test_copies_on_many_sites_survive_line_dedup_once(spark, tmp_path, sf_dir):
    rng = random.Random(3)
    say = lambda n: [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
    show = lambda ls: "\n".join(map(" ".join, ls))
    exact, near, rows = [say(40), say(40), say(40)], [say(40) for _ in range(6)], []
    for k in range(14):
        changed = [list(x) for x in near]
        changed[k % 6][k] = f"changed{k}"
        rows += [(k, show(exact), f"s{k}"), (100 + k, show(changed if k else near), f"s{k}"), (200 + k, show([say(60), "shared by unlike pages".split(), say(60)]), f"s{k}")]
        rows += [(None, show(exact), f"s{k}"), (300, show([*near[:5], say(9)]), f"s{k}")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "line_dedup":
            assert docs.where("text like '%shared by%'").count() == 0 and docs.where("text = ''").count() == 0
    left = defaultdict(set)
    for r in docs.collect():
        left[r["doc_id"]].add(r["text"])
    assert left[0] == {show(exact)} and left[100] == {show(near)} and set(left) == {None, 0, 100, *range(200, 214)}


def test_odd_rows_pass_all_stages(spark, tmp_path, sf_dir):
    rng = random.Random(11)
    say = lambda n: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(n))
    fine, long = say(80), say(60_000)
    rows = [(None, fine), (1, None), (2, ""), (3, "  \n"), (4, fine), (4, fine), (5, say(90)), (5, say(90)), (6, long), (7, long + " end"), (None, None), (8, say(70))]
    names = "row string, text_ string, bad string, gone_id long, key0 int, __n_lines int, n_words int, kept int, copy int"
    docs = spark.createDataFrame([(i, t, None if i == 8 else "en", "s", 0, "x", "x", "x", 1, 2, 3, 4, 5, 6) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            got = docs.collect()
            assert docs.columns == columns and all(tuple(r)[5:] == ("x", "x", "x", 1, 2, 3, 4, 5, 6) for r in got)
            want = [None, 4, 4, 5, 5, 6, 7, 8] if name in ("quality_rules", "line_dedup") else [None, 4, 4, 5, 5, 6, 8]
            assert sorted((r["doc_id"] for r in got), key=str) == sorted(want, key=str), name
    assert sorted({r["doc_id"] for r in docs.collect()}, key=str) == sorted({None, 4, 5, 6, 8}, key=str)


def test_empty_corpus(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_only_the_entry_guards_imports():
    text = open(corpus_pipeline.__file__, encoding="utf-8").read()
    assert not re.search(r"except\s+ImportError", text)
