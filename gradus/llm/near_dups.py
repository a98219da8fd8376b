"""MinHash near-duplicates with tensored banding.

Two collections of ``KEYS`` partial keys, each over a few minhashes (rows), stand for KEYS**2 tables: table (i, j) is keyed by
the pair (first collection's key i, second's key j).  2 * KEYS * rows minhashes thus do the work of
KEYS**2 * 2 * rows.  With 16 keys of 5 minhashes, documents of similarity 0.85 share a table with probability
(1 - (1 - 0.85**5)**16)**2 = 0.9998; the rows follow from the similarity so that this is 0.999 at least.  Pair keys are only formed from partial keys that several documents
share, so documents without near-copies, nearly all of them, emit no pair at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .store import Workspace, small_batches

KEYS, SHINGLE, SEED, RECALL = 16, 5, 20240229, 0.999
FEATURES = "doc_id long, n_shingles long, class binary, first array<long>, second array<long>"


def shingle_set(text: str | None, size: int = SHINGLE):
    """The sorted distinct 64-bit hashes of a text's word shingles (numpy); A-Z are lower-cased, words are divided by
    ASCII white space; a text of fewer words is one shingle; no words, no shingles."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = np.fromiter(map(xxh3_64_intdigest, (text or "").encode().lower().split()), np.uint64)
    if not len(words):
        return words
    n = min(size, len(words))
    count = len(words) - n + 1
    total = np.full(count, n, np.uint64)
    for i in range(n):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def rows_for(percent: int, keys: int = KEYS, recall: float = RECALL) -> int:
    """The most minhashes in a partial key with which documents of that similarity share a table with probability ``recall``."""
    rows = 1
    while (1 - (1 - (percent / 100) ** (rows + 1)) ** keys) ** 2 >= recall:
        rows += 1
    return rows


def partial_keys(shingles, rows: int, keys: int = KEYS, seed: int = SEED):
    """Two arrays of ``keys`` partial keys (int64): the minima of 2 * keys * rows multiply-add hashes, ``rows`` mixed in each."""
    import numpy as np

    n = 2 * keys * rows
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    b = rng.integers(0, 1 << 32, n, np.uint32)[:, None]
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (a * x[None, at : at + 2048] + b).min(axis=1), out=least)
    mixed = np.arange(2 * keys, dtype=np.uint64)
    for column in least.reshape(2 * keys, rows).T:
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + column
    mixed ^= mixed >> np.uint64(32)
    mixed = (mixed * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    return mixed[:keys], mixed[keys:]


def _features(docs: DataFrame, rows: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            out = []
            for text in batch.column("text"):
                s = shingle_set(text.as_py())
                keys = partial_keys(s, rows) if len(s) else ((), ())
                out.append((len(s), xxh3_128_digest(s.tobytes()), *keys))
            n, cls, first, second = zip(*out) if out else ((),) * 4
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(first, lists), pa.array(second, lists)], ["doc_id", "n_shingles", "class", "first", "second"])

    return docs.mapInArrow(run, FEATURES)


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, partners, shingles) of rows (doc_id, text, partners)."""

    def run(batches):
        import pyarrow as pa

        lists = pa.list_(pa.int64())
        for batch in batches:
            sets = [shingle_set(t.as_py()).view("i8") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("partners").cast(lists), pa.array(sets, lists)], ["doc_id", "partners", "shingles"])

    return docs.mapInArrow(run, "doc_id long, partners array<long>, shingles array<long>")


def _tables(reps: DataFrame) -> DataFrame:
    """(key, rep) of the tensored tables, for the pairs of partial keys that two or more representatives share."""
    half = lambda name, side: reps.select("rep", F.lit(side).alias("side"), F.explode(name).alias("part"))
    parts = half("first", 0).union(half("second", 1))
    shared = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
    kept = parts.join(shared, "part").groupBy("rep").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("part"))).alias("first"), F.collect_list(F.when(F.col("side") == 1, F.col("part"))).alias("second")
    )
    return kept.select("rep", F.explode("first").alias("f"), "second").select("rep", F.explode("second").alias("s"), "f").select(F.xxhash64("f", "s").alias("key"), "rep")


def _hidden(members: DataFrame, sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(a, b): pairs of members of one family, of different labels, that may be links; from (a, sa, b, label), b the family's leader.

    A member is written as its difference from the leader's set, n shingles: it lacks d of them and adds e others.  Two
    members whose differences have q elements in common share n - dx - dy + q of n + ex + ey - q shingles, so a link
    needs q * (100 + percent) >= gx + gy + (100 - percent) * n, with g = percent * (n + e) - 100 * (n - d), which is
    positive for members that the leader is not linked with; of two labels one is.  So a link has common elements,
    and an exact prefix and position filter over differences finds it: with elements ordered from rare to
    frequent in the family, the first common one is among the first size - least q + 1 of both, and what
    follows it on either side has to suffice; so an element counts only if rows of two labels have it that early.  The least q
    of x takes y's part, 100 * dy + percent * ey, for the least of the family, and for percent * (ey + dy) at least, as
    100 * (ey + dy) >= gx follows from q <= ey + dy.  Shingles that the family shares are in no difference.
    """
    other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    e, d, n = F.array_except("sa", "sb"), F.array_except("sb", "sa"), F.size("sb")
    # a family is one text of its leader, a row one text of a member: ids may repeat with other texts
    row, family = F.xxhash64("a", "sa").alias("row"), F.xxhash64("b", "sb").alias("b")
    rows = members.join(other, "b").select("a", row, family, "label", n.alias("n"), F.size(e).alias("e"), F.size(d).alias("d"), F.concat(e, d).alias("difference"))
    rows = work.write(rows.withColumn("g", percent * (F.col("n") + F.col("e")) - 100 * (F.col("n") - F.col("d"))), "differences")
    work.release_shuffles()
    bounds = rows.groupBy("b").agg(F.min("g").alias("least"), F.min(F.when(F.col("g") > 0, F.col("g"))).alias("least_unlinked")).where("least_unlinked is not null")
    bounded = rows.join(bounds, "b")
    partner = F.when(F.col("g") > 0, F.col("least")).otherwise(F.col("least_unlinked"))
    part = F.greatest(partner + (100 - percent) * F.col("n"), percent * F.ceil(F.col("g") / F.lit(100)))
    needed = F.greatest(F.lit(1), F.ceil((F.col("g") + part) / F.lit(100 + percent)))
    # elements travel with the keys of their family and row only; what else a row has is joined to the few that the filter leaves
    long = bounded.withColumn("prefix", F.col("e") + F.col("d") - needed + 1).where("prefix > 0").select("b", "row", "label", "prefix", F.explode("difference").alias("s"))
    mixed = (F.min("label") != F.max("label")).alias("mixed")
    spread = long.groupBy("b", "s").agg(F.count(F.lit(1)).alias("df"), mixed)
    ranked = long.join(spread, ["b", "s"]).withColumn("place", F.row_number().over(Window.partitionBy("b", "row").orderBy("df", "s")))
    early = work.write(ranked.where("place <= prefix and mixed").select("b", "row", "s", "place", "label"), "early")
    work.release_shuffles()
    met = early.groupBy("b", "s").agg(mixed).where("mixed").select("b", "s")
    kept = early.join(met, ["b", "s"], "left_semi").groupBy("b", "row").agg(F.collect_list(F.struct("s", "place")).alias("kept"))
    about = rows.select("b", "row", "a", "label", "n", "e", "d", "g").dropDuplicates(["b", "row"])
    firsts = work.write(kept.join(about, ["b", "row"]).withColumn("k", F.explode("kept")).select("b", F.col("k.s").alias("s"), "a", "label", "n", "e", "d", "g", (F.col("e") + F.col("d") - F.col("k.place")).alias("rest")), "prefixes")
    work.release_shuffles()
    own = ("a", "label", "n", "e", "d", "g", "rest")
    left, right = (firsts.select("b", "s", *[F.col(c).alias(f"{c}_{side}") for c in own]) for side in "xy")
    size = lambda side: F.col(f"n_{side}") + F.col(f"e_{side}") - F.col(f"d_{side}")
    fits = (size("x") * 100 >= size("y") * percent) & (size("y") * 100 >= size("x") * percent)
    enough = (1 + F.least("rest_x", "rest_y")) * (100 + percent) >= F.col("g_x") + F.col("g_y") + (100 - percent) * F.col("n_x")
    on = (F.col("label_x") < F.col("label_y")) & ((F.col("g_x") > 0) | (F.col("g_y") > 0)) & fits & enough
    joined = left.alias("l").join(right.alias("r"), (F.col("l.b") == F.col("r.b")) & (F.col("l.s") == F.col("r.s")) & on)
    return joined.select(F.col("a_x").alias("a"), F.col("a_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; documents are linked if 100 * intersection >= percent * union.

    1. One pass over the texts gives each document's set size, a 128-bit digest of its set and its partial keys.
       Documents of one digest have one set: the smallest id stands for all of them from here on.
    2. Representatives meet in the tensored tables.  Each is compared with the smallest of its table on full
       sets; the links found give first components.
    3. Leaders whose members are in several components may hide links that a comparison with the leader does not
       show.  These members are compared among each other by an exact filter on their differences from the
       leader (see _hidden), and the pairs that remain are verified on full sets.

    So no bucket is capped, no group emits all its pairs, and every pair that a table holds is decided.
    Null and empty texts have no shingles and are linked with nothing.  Rows that repeat an id are one document,
    of the union of their links, also if their texts differ.  A null id gets a null component and null ``kept``.  Very long texts are
    hashed whole, 2048 shingles at a time; of equal documents (ties) the smallest id is kept.  An empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "near")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = work.write(_features(source, rows_for(percent)), "features")
    classes = features.where("n_shingles > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("first").alias("first"), F.first("second").alias("second"))
    reps = work.write(classes, "reps")
    tables = work.write(_tables(reps), "tables")
    work.release_shuffles()

    least = tables.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader")
    stars = tables.join(least, "key").select("rep", "leader").distinct()
    partners = work.write(stars.groupBy("rep").agg(F.array_distinct(F.filter(F.collect_list("leader"), lambda x: x != F.col("rep"))).alias("partners")), "partners")
    with_text = source.join(partners.withColumnRenamed("rep", "doc_id"), "doc_id")
    sets = work.write(_sets(with_text), "sets").dropDuplicates(["doc_id", "shingles"])
    work.release_shuffles()

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among (a, b, sa): b's set is joined, both sets are compared in full."""
        other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(other, "b").where(both * 100 >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    star_pairs = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"), F.explode("partners").alias("b"))
    # texts of one id are one document
    known = features.where("n_shingles > 0 and doc_id is not null")
    several = known.groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("doc_id")
    own = known.join(several, "doc_id", "left_semi").select("doc_id", "class").distinct().join(reps.select("class", "rep"), "class").select("doc_id", "rep")
    same = own.groupBy("doc_id").agg(F.min("rep").alias("b")).join(own, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    links = work.write(verified(star_pairs).union(same), "links")
    work.release_shuffles()
    labels = work.write(components(links, work, "first"), "labels")

    # whether a leader's members differ is aggregated before it meets the leader, so one with many members is no hot row of the join
    label_of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    families = star_pairs.select("a", "b").join(label_of("a"), "a", "left").select("a", "b", F.coalesce("a_label", "a").alias("label"))
    spread = families.groupBy("b").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).join(label_of("b"), "b", "left")
    own = F.coalesce("b_label", "b")
    mixed = spread.where((F.least("lo", own) != F.greatest("hi", own)) & (F.col("n") > 1)).select("b")
    members = work.write(families.join(mixed, "b", "left_semi"), "members")
    work.release_shuffles()
    if not members.isEmpty():
        more = verified(_hidden(star_pairs.join(members, ["a", "b"]), sets, percent, work).join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a"))
        links = work.write(links.union(more), "all-links")
        work.release_shuffles()
        labels = work.write(components(links, work, "second"), "all-labels")
    work.release_shuffles()
    for name in ("tables", "partners", "sets", "links", "members", "differences", "early", "prefixes"):
        work.drop(name)  # the result reads features, classes and labels only
    repeated = known.join(reps.select("class", "rep"), "class").select("doc_id", "rep")
    placed = repeated.join(labels.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("component"))
    out = features.join(placed, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
