"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations by node and two joins; hubs are pre-aggregated on the map side, and no
task holds a node's neighbours. Edges shrink to stars around each component's least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or not larger neighbours to the least node around it."""
    both = edges.union(edges.select("v", "u")) if large else edges
    # small star: edges run from the larger node u to the smaller v
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    inner = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.union(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the least node reachable."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
    now, seen, at = scratch.keep(down, f"{name}-0"), None, 0
    while True:
        at += 1
        small = _star(_star(now, True).where(F.col("u") != F.col("v")).distinct(), False).distinct()
        nxt = scratch.keep(small, f"{name}-{at}")
        # A sum of hashes over the edges tells whether the round has changed anything.
        sign = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{at - 1}")
        if sign == seen:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).union(nxt.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now, seen = nxt, sign
