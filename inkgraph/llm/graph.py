"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Edges (u, v). Large star: every larger neighbour of a node links to the node's least neighbour.
    Small star: the node and its smaller neighbours link to the least of them.

    Counting per node happens in partial aggregates; no node's neighbours are collected. The join back
    has one row per node on one side; cut writes that side, so no aggregate stands between shuffle and join and Spark
    may split a node with very many larger neighbours. Small stars follow large ones, where such nodes have few smaller."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u long, v long) to (node, root) for every node with an edge; root is the least node reachable.

    Self-loops, repeated and reversed edges and nulls are allowed (edges with a null end are no links).
    Only two counters reach the driver per round. Rounds go on until the edges settle,
    after about the logarithm of the longest chain."""
    edges = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = scratch.cut(edges, "edges-0"), None
    for k in itertools.count(1):
        large = _star(now, True, lambda df, name=f"least-{k}": scratch.cut(df, name))
        after = scratch.cut(_star(large, False), f"edges-{k}")
        mark = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        scratch.drop(f"edges-{k - 1}")
        scratch.drop(f"least-{k}")
        if tuple(mark) == seen:
            return after.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(after.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("root")))
        now, seen = after, tuple(mark)
