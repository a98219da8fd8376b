import collections
import random
import re
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from gradus.llm import line_spread, near_dups, substring_dups
from gradus.llm.components import components
from gradus.llm.store import Workspace

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, i = [], 0

    def add(text):
        nonlocal i
        i += rng.randint(1, 5)
        rows.append((i, text))

    passage = say(60)
    for k in range(40):
        add(say(rng.randint(0, 60)))
    for k in range(25):
        base = say(120).split()
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(WORDS)
            add(" ".join(other))
        chain = list(base)
        for _ in range(6):
            chain[rng.randrange(len(chain))] = "new" + str(rng.randint(0, 99))
            add("\n".join([" ".join(chain[:50]), " ".join(chain[50:])]))
    for k in range(30):
        add(say(rng.randint(1, 40)) + " " + passage + "  " + say(rng.randint(0, 9)))
    same = say(70)
    for k in range(12):
        add(same)
    rows += [(i + 1, None), (i + 2, ""), (i + 3, "  \n "), (i + 4, "Short one"), (i + 5, "short ONE"), (i + 6, "É x"), (i + 7, "é x")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, 4, 5, 6) for r in rows], "doc_id long, text string, class string, label int, copy int, digest int, shingles int").repartition(7)


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    for percent in (85, 80):
        sets = {i: shingles(t) for i, t in rows}
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        ids = sorted(sets)
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(frame(spark, rows), percent=percent).collect()}
        assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_odd_rows(spark):
    docs = frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (4, None)])
    got = sorted(map(tuple, near_dups.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, None), (3, 2, 1, False), (3, 2, 1, False), (1, 2, 1, True), (4, 0, 4, True)], key=str)
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0
    say = lambda seed, n=200: [f"z{random.Random(seed).randint(0, 9)}{seed}{i}" for i in range(n)]
    u, t, long = say(1), say(2), say(3, 60_000)
    other = lambda w: " ".join([*w[:100], "changed", *w[101:]])
    rows = [(50, " ".join(u)), (50, " ".join(t)), (50, " ".join(say(4))), (60, other(u)), (40, other(t)), (70, " ".join(say(4))), (80, " ".join(long)), (81, other(long)), (82, " ".join(say(5)))]
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(frame(spark, rows)).collect()}
    assert got == {40: 40, 50: 40, 60: 40, 70: 40, 80: 80, 81: 80, 82: 82}


def test_recall_of_tables_at_the_threshold():
    rng = random.Random(1)
    for percent, least in ((85, 0.997), (80, 0.995)):
        rows, met = near_dups.rows_for(percent), 0
        for _ in range(600):
            n = 200
            common = -(-2 * n * percent // (100 + percent))  # the least that links two sets of n
            both = [rng.getrandbits(64) for _ in range(common)]
            a, b = ([*both, *(rng.getrandbits(64) for _ in range(n - common))] for _ in range(2))
            (f, s), (g, t) = (near_dups.partial_keys(np.array(x, np.uint64), rows) for x in (a, b))
            met += bool((f == g).any() and (s == t).any())
        assert met / 600 >= least


def test_prefix_filter_finds_links_the_smallest_member_hides(spark):
    base = [f"c{i}" for i in range(300)]
    rows = [(k, " ".join(base[k * 6 : k * 6 + 150])) for k in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(frame(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    linked = 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1])
    assert linked and set(got.values()) == {0}


def test_hidden_links_are_all_found(spark):
    rng = random.Random(12)
    members, sets, want = [], {}, set()
    for family in range(8):
        leader = 1000 * family
        sets[leader] = set(rng.sample(range(10**9), 60))
        pool, ids = rng.sample(range(10**9), 40), []
        for k in range(1, 25):
            out = set(sets[leader]) if k % 3 else set(sets[rng.choice(ids or [leader])])
            for _ in range(rng.randint(0, 14)):
                out.discard(rng.choice(sorted(out)))
                out.add(rng.choice(pool) if rng.random() < 0.6 else rng.randint(0, 10**9))
            sets[leader + k] = out
            ids.append(leader + k)
        for percent in (85,):
            like = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
            label = {i: leader if like(i, leader) else i for i in ids}
            members += [(i, sorted(sets[i]), leader, label[i]) for i in ids]
            want |= {(a, b) for a in ids for b in ids if label[a] < label[b] and like(a, b)}
    m = spark.createDataFrame(members, "a long, sa array<long>, b long, label long")
    full = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "doc_id long, shingles array<long>")
    got = {(r["a"], r["b"]) for r in near_dups._hidden(m, full, 85, Workspace(spark, "test")).collect()}
    assert len(want) > 20 and want <= got and len(got) < len(members) * 24


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test"), "t").collect()
    want = {x: find(x) for x in root if any(x in ab and ab[0] != ab[1] for ab in links)}
    assert {r["node"]: r["label"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test"), "t").count() == 0


def without_repeats(rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][p : p + 13]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), sha256(kept.encode()).hexdigest(), kept)
    return out


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus(5)
    for batches in (1, 4, 7):
        got = {r["doc_id"]: tuple(r)[1:] for r in substring_dups.remove_repeats(frame(spark, rows), batches=batches).collect()}
        assert got == without_repeats(rows)


def test_substring_dedup_odd_rows(spark):
    long = " ".join(WORDS[:20])
    docs = frame(spark, [(None, long), (2, long), (2, long), (7, "x " + long), (1, None), (9, long)])
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dups.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(None, 20, 0, long), (2, 20, 0, long), (2, 20, 0, long), (7, 21, 20, "x"), (1, 0, 0, ""), (9, 20, 20, "")], key=str)
    assert substring_dups.remove_repeats(docs.limit(0)).count() == 0


def test_index_takes_batch_after_batch(spark, tmp_path):
    rows = corpus(6)
    long = [f"long{i % 30_000}" for i in range(60_000)]
    rows += [(9000, " ".join(long)), (9001, " ".join(["x", *long[20_000:20_040], "y"]))]
    rows += [(9100, "two texts " + rows[60][1]), (9100, rows[60][1]), (9200, "more two texts " + rows[60][1])]
    order = lambda rs: sorted(rs, key=str)
    named = lambda i: f"file://{tmp_path}/index{i}"
    for k, split in enumerate((lambda i, n: i * 5 // n, lambda i, n: 2 - i * 3 // n)):  # ascending ids, descending ids
        seen = []
        for batch in range(5 - 2 * k):
            part = [r for i, r in enumerate(rows) if split(i, len(rows)) == batch]
            seen += part
            index = substring_dups.FingerprintIndex.open(spark, named(k), fan_in=3)
            got = [tuple(r) for r in substring_dups.absorb_documents(frame(spark, part), index).collect()]
            assert all(len(index.runs[kind]) <= 3 for kind in ("fps", "windows", "digests")) and len(index.runs["texts"]) == batch + 1
            want = order(without_repeated_ids(seen))
            assert order(got) == [w for w in want if w[0] in {r[0] for r in part}]
            if k == 0 and batch == 4:
                assert order(tuple(r) for r in substring_dups._removed(index.verdicts()).collect()) == [w for w in want if w[0] is not None]
            index.close()
    index = substring_dups.FingerprintIndex.open(spark, named(0))
    assert index.version >= 5
    again = substring_dups.absorb_documents(frame(spark, [(99_999, " ".join(long[100:150]))]), index)
    with substring_dups._sorted_scans(spark):
        plan = index._table(index.runs["fps"][0]).hint("merge").join(index._table(index.runs["fps"][-1]), "fp")._jdf.queryExecution().executedPlan().toString()
    assert again.first()["n_removed"] == 50 and "Exchange" not in plan and "Sort " not in plan
    index.close()


def without_repeated_ids(rows):
    """As without_repeats, for rows that may repeat an id."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(words):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    out = []
    for i, w in words:
        gone = {p + k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for k in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha256(kept.encode()).hexdigest(), kept))
    return out


def test_line_spread(spark):
    rng = random.Random(6)
    lines = ["one two three", " one two three\t", "two words", "rare line is here", "", "edge line at four sites"]
    rows = []
    for i in range(60):
        text = "\n".join([f"own line number {i}", *(rng.choice(lines[:5]) for _ in range(rng.randint(0, 5)))])
        rows.append((i, text, f"s{i % 7}" if i % 11 else None))
    rows += [(100 + k, "edge line at four sites", f"s{k}") for k in range(4)] + [(110 + k, "five five five", f"s{k % 3}") for k in range(20)]
    rows += [(200, None, "s1"), (201, "", "s1"), (None, "one two three", "s2"), (5, "one two three\nleft", "s3"), (5, "one two three\nleft", "s3")]
    rows += [(300, "\n".join([*(f"own {k} words" for k in range(20_000)), "one two three"]), "s1")]
    docs = spark.createDataFrame([(*r, "k", 7, 8, 9, "id") for r in rows], "doc_id long, text string, source string, line string, site int, __bad int, __id int, bad string")
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for sites in (4, 5):
        at = collections.defaultdict(set)
        for _, t, s in rows:
            for x in (t or "").split("\n"):
                if len(strip(x).split()) >= 3 and s:
                    at[strip(x)].add(s)
        bad = {x for x, s in at.items() if len(s) >= sites}
        want = []
        for i, t, s in rows:
            ls = [] if t is None else t.split("\n")
            kept = [x for x in ls if i is None or strip(x) not in bad]
            want.append((i, None if t is None else "\n".join(kept), s, "k", 7, 8, 9, "id", len(ls), len(ls) - len(kept)))
        got = line_spread.remove_spread_lines(docs, sites=sites)
        assert got.columns == [*docs.columns, "__n_lines", "__n_removed"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert line_spread.remove_spread_lines(docs.limit(0)).count() == 0
    clash = docs.withColumns({"__n_lines": F.lit("x"), "text": F.lit("a b c\nown")})
    assert line_spread.remove_spread_lines(clash, counts=None).first()["__n_lines"] == "x" and line_spread.remove_spread_lines(clash).first()["__n_lines"] == 2
