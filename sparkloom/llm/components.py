"""Connected components of an edge table by alternating large and small stars, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, discard, join_hot, settle


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node it reaches) of every node of the edges (a, b); a null end has no edge."""
    known = edges.where("a is not null and b is not null and a != b")
    edges = settle(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = _mark(edges)
    while mark[0]:
        # Large star: what is greater than a node is tied to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = join_hot(both, least, ["a"], 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large if 2 * mark[0] <= BROADCAST_IDS else large.distinct()  # a row an edge: few need no shuffle
        # Small star: a node and its lesser neighbours are tied to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_hot(large, low, ["a"], mark[0]).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b")
        last, edges = edges, settle(small.distinct(), "cc")
        discard(last)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    # Now an edge ties each node to its root.
    out = settle(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "cc-roots")
    discard(edges)
    return out


def apart(pairs: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """(a, b, root_a, root_b) of the pairs (a, b) whose components differ, by the ``n`` roots known."""
    for side in ("a", "b"):
        pairs = join_hot(pairs, roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), [side], n, "left")
        pairs = pairs.withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.where("root_a != root_b").select("a", "b", "root_a", "root_b")


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of the edges that made ``roots`` and these: only what ties components is followed."""
    new = components(apart(edges, roots, roots.count()).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    n = new.count()
    moved = join_hot(roots, new.select(F.col("node").alias("root"), F.col("root").alias("to")), ["root"], n, "left")
    moved = moved.select("node", F.coalesce("to", "root").alias("root"))
    # A root that is known is a node of its own component.
    others = join_hot(new, roots.select("node"), ["node"], roots.count(), "left_anti")
    out = settle(moved.unionByName(others), "cc-roots")
    discard(new)
    return out
