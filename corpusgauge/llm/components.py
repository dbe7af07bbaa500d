"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a min per node (a partial aggregate: the edges of a hub are combined in their
own tasks) and a many-to-one join; each round's edges are written to the shared folder.  The
number of rounds grows with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import written


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """``pairs`` (u, v): link the neighbours of u to the smallest of them and u itself; the
    larger neighbours only (large star), or u and the smaller ones only (small star)."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame):
    """Edge count and an order-free digest, to see when nothing changes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of any order -> (node, label): every node that has an edge to another
    node, and the smallest node it can reach.  Loops and repeated edges are ignored."""
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = written(_star(both, large=True), "large-star")
        edges = written(_star(grown.filter("v < u"), large=False), "small-star")
        now = _state(edges)
        if now == state:
            break
        state = now
    # stars now: every node points at its component's smallest
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
