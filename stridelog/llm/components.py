"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed; each round writes its edges to the shared folder, until a
round changes none, and deletes those of the round before. A
node's least neighbour goes back to its edges by (node, salt): a hub's edges are
spread over ``SALTS`` keys, and beyond that adaptive execution may split the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, release

SALTS = 64


def _star(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Adds ``least``: the smallest of each ``node`` and its ``other`` ends in ``edges``."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    local = salted.groupBy(node, "salt").agg(F.min(other).alias("low"))
    least = local.select(F.col(node).alias("n"), F.col("salt").alias("s"), F.least(node, F.min("low").over(Window.partitionBy(node))).alias("least"))
    return salted.join(least, (salted[node] == least["n"]) & (salted["salt"] == least["s"])).drop("n", "s", "salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest reachable node) for every node of an edge between two nodes."""
    edges = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = None
    while True:
        sums = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if not sums["n"] or sums == before:
            break
        before = sums
        # large star: neighbours above a node go to the least of its neighbours
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        large = _star(both, "u", "v").where("v > u").select(F.col("v").alias("hi"), F.col("least").alias("lo")).distinct()
        # small star: a node and its neighbours below go to the least of them
        small = _star(large, "hi", "lo")
        older, edges = edges, materialize(small.select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("least").alias("lo")).where("hi != lo").distinct())
        release(older)
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
