"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins; no edge ever visits the driver. A hub's minimum is merged before the shuffle, and the
minima are dealt out apart from the edges that they join, so adaptive execution splits a hub's edges among tasks. Rounds grow with
the logarithm of the graph's size; each is cut by a checkpoint.

Defined results: rows with a null end and loops are ignored, repeated edges are one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut, settled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. large: every larger neighbour of u goes to u's smallest; small: every smaller one, and u, do."""
    if large:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(apart(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(apart(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return out.where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(settled(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))), lambda d: d.first()))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) of every node that has an edge; label is the smallest node of its component. Null ends are ignored."""
    edges = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), fresh=True)
    before = _state(edges)
    while before[0]:
        edges = cut(_star(_star(edges, True), False), fresh=True)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct().toDF("node", "label"))
