"""Distributed union-find: connected components by alternating large-star and small-star steps.

Each step replaces edges by edges to smaller nodes, so the edge set never grows beyond what it was
plus one edge for each node, and it ends as one star for each component, after about the logarithm
of the longest path of rounds. Edges stay in tables; the driver sees one count and one checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root) of every node that has an edge to another one; root is the smallest node
    reachable. Nodes may be of any type with an order, structs included. Nulls and loops are
    ignored, repeated edges count once; no edges give no rows.
    """
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    falls = F.col("x") > F.col("y")
    now = links.select(F.when(falls, F.col("x")).otherwise(F.col("y")).alias("u"), F.when(falls, F.col("y")).otherwise(F.col("x")).alias("v"))
    now = written(now.distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        least = least.select("x", F.when(F.col("m") < F.col("x"), F.col("m")).otherwise(F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(lowest.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        dropped(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select("v", "v").distinct())

