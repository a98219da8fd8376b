"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Workspace


def _pairs(df: DataFrame, a, b) -> DataFrame:
    return df.select(F.col(a).alias("a") if isinstance(a, str) else a.alias("a"), F.col(b).alias("b") if isinstance(b, str) else b.alias("b"))


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node reachable.

    Each round is written to the shared folder, so lineage stays short; links, labels and counts of nodes stay
    distributed, and the driver sees two numbers a round.  Rounds grow with the logarithm of the longest
    path.  The minimum of a node's neighbours is aggregated before shuffling.  Joining it back sends a hub's links to one task where both
    sides are shuffled; that is a plain join, whose large partitions Spark's adaptive execution divides.  Shuffle files of a round go
    before the next.
    """
    edges = work.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    stamp = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, k = stamp(edges), 0
    while True:
        both = _pairs(edges, "a", "b").union(_pairs(edges, "b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        edges_next = work.write(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-{k}")
        after = stamp(edges_next)
        work.drop(f"{name}-{k - 1}")
        work.release_shuffles()
        edges = edges_next
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
