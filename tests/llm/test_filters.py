import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import classifier, decontaminate, preferences, quality_rules, queries
from gradus.llm.store import Workspace


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    marks = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marks)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_docs(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b", " ", " ", "\n", "\x0b", "#", "<", "é ", "\xa0", "😀"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += [None, "", "   \n", "a", "a b", "a b c", "a b c a b c", "x " * 500, " ".join(f"v{i % 7000}" for i in range(70_000)), "line\nline\n line\n", "$ \\1 %"]
    clean = [" ".join(f"v{rng.randint(0, 999)}" for _ in range(80)) for _ in range(160)]
    noisy = [" ".join(f"v{rng.randint(0, 999)}&&" for _ in range(80)) for _ in range(6)]
    rows = [(i, t, "en", None if i % 5 == 0 else "s") for i, t in enumerate(texts)] + [(1000 + i, t, "de", "s") for i, t in enumerate(clean)] + [(2000 + i, t, "de", "s") for i, t in enumerate(noisy)]
    rows += [(None, clean[0], None, None), (1000, clean[0], "de", "s")]
    return spark.createDataFrame([(*r, 1.5, "t", 1, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, source string, kept double, metric string, row int, key0 int, n_words int, __limit_symbol_mille int"), rows


def test_quality_measures_and_verdicts(spark):
    docs, rows = quality_docs(spark)
    report = quality_rules.quality_report(docs)
    assert "Python" not in report._jdf.queryExecution().executedPlan().toString()
    got = report.collect()
    key = lambda i, b: (str(i), b)
    assert sorted(key(r["doc_id"], tuple(r[c] for c in BASE)) for r in got) == sorted(key(r[0], brute(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        if r["doc_id"] is not None and r["doc_id"] >= 1000:
            assert r["kept"] == (r["doc_id"] < 2000)
    few = quality_rules.quality_report(docs.where("doc_id >= 1030 and (doc_id < 1060 or doc_id = 2000)")).collect()
    assert len(few) == 31 and all(r["kept"] == (r["doc_id"] < 2000) for r in few)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.quality_report(docs.limit(0)).count() == 0 and quality_rules.filter_documents(docs.limit(0)).count() == 0


def test_bad_rows_under_half_of_a_group_do_not_loosen_its_limits(spark):
    rng = random.Random(4)
    say = lambda n, end="": " ".join(f"v{rng.randint(0, 10**6)}{end}" for _ in range(n))
    rows = [(i, say(80), "en", "s") for i in range(140)] + [(1000 + i, say(80, "&&"), "en", "s") for i in range(60)]
    rows += [(i, say(80), "de", "s") for i in range(200, 340)] + [(2000 + i, "\n".join(f"ok\n{say(8)}" for _ in range(12)), "de", "s") for i in range(60)]
    report = quality_rules.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in report) and {r["doc_id"] for r in report if r["kept"]} == set(range(140)) | set(range(200, 340))
    spread = spark.createDataFrame([("g", m, b, 50) for m in quality_rules.METRICS for b in (100, 304, 504, 904)], "g string, metric string, bucket long, n long")
    limit = quality_rules._limits_of(spread, ["g"]).first()
    assert all(304 <= limit[m] < 1000 for m in ("symbol_mille", "dup_line_mille", "repeat_mille"))


def test_limits_are_the_groups_own_and_follow_its_rows_smoothly(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    report = quality_rules.quality_report(docs).join(docs.select("doc_id", "lang", "source"), "doc_id")
    rows = report.groupBy("lang", "source").agg(*[F.max(f"limit_{m}").alias(m) for m in quality_rules.METRICS], F.sum(F.when(~F.col("base_failed") & ~F.col("kept"), 1)).alias("rejected")).collect()
    for m in ("dup_line_mille", "repeat_mille", "word_len_cents"):
        (_, most), = collections.Counter(r[m] for r in rows).most_common(1)
        assert most < len(rows) / 2, m
    assert sum(r["rejected"] or 0 for r in rows) > 300
    say = lambda n, seed: [" ".join(f"v{random.Random(seed * 1000 + i).randint(0, 9)}{'x' * (i % 7)}" for i in range(k, k + 80)) for k in range(n)]
    found = []
    for n in (20, 60, 99, 100, 101, 400):
        rows = [(i, t, "en", "large") for i, t in enumerate(say(600, 1))] + [(1000 + i, t + " " + "long" * 60, "en", "small") for i, t in enumerate(say(n, 2))]
        report = quality_rules.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
        found.append(report.where("doc_id >= 1000").first()["limit_word_len_cents"])
    assert found == sorted(found) and found[0] < found[-1] and found[4] - found[2] <= 5


def test_sketch_is_exact_to_a_64th_and_merges(spark):
    values = [random.Random(1).randint(0, 10**9) >> random.Random(i).randint(0, 30) for i in range(2000)] + [0, 127, 128, 129, 2**40]
    df = spark.createDataFrame([("k", v) for v in values], "g string, m long")
    whole = quality_rules.sketch(df, ["g"], ["m"])
    halves = quality_rules.sketch(df.where("m % 2 = 0"), ["g"], ["m"]).union(quality_rules.sketch(df.where("m % 2 = 1"), ["g"], ["m"])).groupBy("g", "metric", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, halves.collect()))
    got = quality_rules.quantiles(whole, ["g"], {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
    for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
        want = sorted(values)[max(0, -(-int(len(values) * p * 100) // 100) - 1)]
        assert want * (1 - 1 / 32) - 2 <= got[name] <= want * (1 + 1 / 32) + 2


def item_words(text):
    return re.sub(r"[^0-9A-Za-z\x80-\U0010ffff]", " ", (text or "").lower()).split()


def overlap_words(w, m):
    """The most words of item m that overlaps with w cover at one shift; 0 without an overlap."""
    size = min(13, len(m))
    if not m or len(m) < 5 and len(w) != len(m):
        return 0
    covered = collections.defaultdict(set)
    for q in range(len(m) - size + 1):
        for p in range(len(w) - size + 1):
            if sum(a == b for a, b in zip(w[p : p + size], m[q : q + size])) >= size - 2 * size // 13:
                covered[p - q] |= set(range(q, q + size))
    return max(map(len, covered.values()), default=0)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([1, 3, 4, 5, 6, 7, 9, 12, 13, 14, 30])))) for k in range(60)] + [(90, None), (None, "x y z u v w"), (91, ""), (92, "?! --"), (7, " ".join(say(20)))]
    items += [(93, items[12][1]), (12, items[12][1])]
    docs = []
    for i in range(300):
        w = say(rng.randint(0, 60)) if i % 3 else []
        if i % 2:
            part = item_words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(part) - 13))
            part = part[a : a + rng.randint(5, 30)]
            for _ in range(rng.randint(0, 4)):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in part]
        docs.append((i, " ".join(w)))
    docs += [(None, None), (900, None), (901, ""), (1, docs[1][1]), (902, " ".join(say(60_000)) + " " + items[0][1] + " " + " ".join(item_words(items[-3][1])))]
    want = {}
    for i, t in docs:
        w = item_words(t)
        for k, x in items:
            if k is not None and x is not None and (n := overlap_words(w[-200:] if i == 902 else w, item_words(x))):
                want[i, k] = max(n, want.get((i, k), 0))
    d = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in docs], "doc_id long, text string, item_id string, seed int, place int, words int").repartition(5)
    b = spark.createDataFrame([(*r, 1, 2, 3) for r in items], "item_id long, text string, doc_id int, key int, seeds int")
    for most in (300_000, 0):
        old, decontaminate.BROADCAST_SEEDS = decontaminate.BROADCAST_SEEDS, most
        try:
            got = {(r["doc_id"], r["item_id"]): r["words"] for r in decontaminate.find_contamination(d, b, Workspace(spark, "t")).collect()}
        finally:
            decontaminate.BROADCAST_SEEDS = old
        assert got == want and {min(13, len(item_words(items[k][1]))) for _, k in want if k < 60} >= {1, 5, 7, 9, 12, 13}
    report = decontaminate.contamination_report(d, b)
    assert report.count() == len(docs) and {r["doc_id"] for r in report.where("contaminated").collect()} == {i for i, _ in want}
    assert decontaminate.contamination_report(d.limit(0), b).count() == 0 and decontaminate.contamination_report(d, b.limit(0)).where("contaminated").count() == 0


def test_decontamination_with_a_million_benchmark_words(spark):
    rng = random.Random(10)
    items = [[f"w{rng.randint(0, 10**6)}" for _ in range(40)] for _ in range(25_000)]
    docs = [[f"w{rng.randint(0, 10**6)}" for _ in range(150)] for _ in range(400)]
    want = set()
    for i in range(0, 400, 4):
        k, a = rng.randrange(len(items)), rng.randint(0, 20)
        part = list(items[k][a : a + 15])
        part[3] = part[9] = "changed"
        docs[i][50:65] = part
        want.add((i, k))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").repartition(8)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(d, b, Workspace(spark, "t")).collect()}
    assert got == want


def test_sql_of_decontamination_has_short_items(spark):
    docs = [(1, "One two three, four five six!"), (2, "a b"), (3, "a b c"), (4, "say: seven words are here CHANGED for us now"), (5, None), (6, "--")]
    items = [(1, "one two three four five six"), (2, "A B"), (3, "seven words are here with for us"), (4, ""), (5, "one two three four five")]
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.execute("create table benchmark (item_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", docs)
    c.executemany("insert into benchmark values (?, ?)", items)
    got = {r[0]: r[1:] for r in c.execute(f"select doc_id, item_ids, words from ({queries.ORACLES['op6_decontamination']})").fetchall()}
    assert got == {1: ("1,5", 6), 2: ("2", 2), 3: ("", 0), 4: ("3", 7), 5: ("", 0), 6: ("", 0)}
    report = decontaminate.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: (",".join(map(str, r["item_ids"])), r["words"]) for r in report.collect()} == got


def test_masks_cover_two_substitutions():
    kept = [{p for k in mask for at, n in [decontaminate.BLOCKS[k]] for p in range(at, at + n)} for mask in decontaminate.MASKS]
    assert all(any(not {a, b} & k for k in kept) for a in range(13) for b in range(13))
    for length in range(1, 13):
        blocks, masks = decontaminate.blocks_of(length)
        assert sorted(p for at, n in blocks for p in range(at, at + n)) == list(range(length)) and len(masks) == decontaminate.allowed(length) + 1 == len(blocks)


def test_preferences(spark):
    rows = [
        (1, True, 0, "user", "hi"), (1, True, 2, "assistant", "yes"), (1, True, 5, "user", "bye"),
        (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "no"),
        (2, True, 0, "user", "same"), (2, False, 0, "user", "same"),
        (3, True, 0, None, None), (3, True, 1, "assistant", "é"), (3, False, 0, None, None), (3, False, 1, "assistant", "é"), (3, False, 2, "assistant", "z"),
        (4, True, 0, "assistant", "only"), (None, True, 0, "user", "x"), (5, None, 0, "user", "x"),
        (6, True, 0, "user", "a"), (6, True, 0, "user", "a"), (6, False, 0, "user", "a"),
    ]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, rank int").repartition(5)
    done = preferences.format_preferences(turns)
    assert "Python" not in done._jdf.queryExecution().executedPlan().toString()
    show = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    got = {r["pair_id"]: r for r in done.collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    one = got[1]
    assert one["prefix_turns"] == 1 and one["prompt"] == show("user", "hi") and one["chosen"] == show("assistant", "yes") + show("user", "bye") and one["rejected"] == show("assistant", "no")
    for r in got.values():
        for side in ("chosen", "rejected"):
            for s in r[f"{side}_mask"] or []:
                assert r[side][s["start"] : s["end"]].endswith("<|end|>\n") and r[side][: s["start"]].endswith("<|assistant|>\n")
    assert one["chosen"][one["chosen_mask"][0]["start"] : one["chosen_mask"][0]["end"]] == "yes<|end|>\n" and len(one["chosen_mask"]) == 1
    assert (got[2]["prefix_turns"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")
    assert (got[3]["prefix_turns"], got[3]["chosen"], got[3]["rejected"]) == (2, "", show("assistant", "z"))
    assert (got[4]["prompt"], got[4]["chosen"], got[4]["rejected"], got[4]["rejected_mask"]) == ("", show("assistant", "only"), None, None)
    assert (got[6]["prefix_turns"], got[6]["chosen"], got[6]["rejected"]) == (1, show("user", "a"), "")
    assert preferences.format_preferences(turns.limit(0)).count() == 0


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df, found = queries.QUERIES[name](spark, sf_dir), con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    key = lambda r: tuple(map(str, r))
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(names).collect()), key=key) == sorted(found.fetchall(), key=key)


def test_classifier_on_held_out_rows(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op1_quality_classifier(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.97


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"good text number {i}" if i % 2 else "&& ## $$ " * (i + 1), 1) for i in range(60)] + [(None, "x", 1), (70, None, 1), (71, "", 1), (3, "good text number 3", 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(60)] + [(None, 1, 5), (5, None, 5), (5, 1, 5)], "doc_id long, quality int, text int")
    w = classifier.fit(docs, labels)
    assert (w == classifier.fit(docs.repartition(9), labels.repartition(3))).all()
    got = classifier.score(docs, w).collect()
    assert len(got) == 64 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[70] == by[71] and min(by[i] for i in range(1, 60, 2)) > max(by[i] for i in range(0, 60, 2))
    assert not classifier.fit(docs, labels.limit(0)).any() and classifier.score(docs.limit(0), w).count() == 0
    small = classifier.FtrlConfig(max_rows=20, shard_rows=5)
    assert classifier.fit(docs, labels, config=small).any()
    long = "good " * 70_000
    assert classifier.features(long, 18)[0].size == 5 and len(classifier.tokens("A1, b#")) == 4
    clash = docs.withColumns({"weight": F.lit("x"), "score": F.lit("y"), "id": F.lit(1)})
    assert (classifier.fit(clash, labels.withColumn("id", F.lit(2))) == w).all() and classifier.score(clash, w).columns == ["doc_id", "score"]


def test_training_equals_plain_ftrl():
    rng, config = random.Random(5), classifier.FtrlConfig(bits=12, epochs=3)
    texts = [" ".join(rng.choice(["red", "blue", "green", "&", "x1"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    labels, weights = [float("red" in t) for t in texts], [rng.choice([0.5, 2.0]) for _ in texts]
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= config.l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * config.l1) / ((config.beta + math.sqrt(n[i])) / config.alpha + config.l2)

    for _ in range(config.epochs):
        for k, t in enumerate(texts):
            row = [(int(i), float(x)) for i, x in zip(*classifier.features(t, config.bits))]
            own = {i: weight(i) for i, _ in row}
            p = 1 / (1 + math.exp(-sum(own[i] * x for i, x in row)))
            for i, x in row:
                g = (p - labels[k]) * weights[k] * x
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / config.alpha
                z[i] += g - sigma * own[i]
                n[i] += g * g
    got = classifier._train(texts, labels, weights, config, lambda m, epoch: range(m))
    want = np.zeros(len(got))
    for i in list(z):
        want[i] = weight(i)
    assert np.allclose(got, want, atol=1e-5) and np.count_nonzero(want) > 10


def test_features_are_hashed_n_grams():
    index, values = classifier.features("Red blue, red blue2 99 99 99", 18)
    words = ["red", "blue", ",", "red", "blue0", "00", None, None]
    hashed = [1 if w is None else zlib.crc32(w.encode()) for w in words]
    assert classifier.tokens("Red blue, red blue2 99 99 99") == [b"red", b"blue", b",", b"red", b"blue0", b"00", b"00", b"00"]
    mix, top = 0x9E3779B97F4A7C15, 1 << 64
    grams = [h * mix % top >> 46 for h in hashed] + [(a * mix + b) % top * mix % top >> 46 for a, b in zip(hashed, hashed[1:])]
    counts = collections.Counter(grams)
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    assert dict(zip(index.tolist(), values.tolist())) == pytest.approx({0: 1.0} | {g + 1: math.log1p(c) / norm for g, c in counts.items()})
