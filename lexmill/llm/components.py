"""Distributed connected components.

Rounds of large-star and small-star turn the edges of each component into a
star around its smallest node. A round costs a few joins and aggregations with
map-side combining. A node with very many edges meets them in a join, which
adaptive execution splits; they are never held as a list, nor brought to the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("h")).first()
    return found.n, found.h or 0


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that joins two nodes; root is the
    component's smallest node. Loops and rows with a null are ignored; repeated
    edges count once; no edges give no rows."""
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(F.col("v") != F.col("u"))
    e = scratch.save(e.where(edges[a].isNotNull() & edges[b].isNotNull()).distinct(), "edges0")
    mark = _mark(e)
    for k in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select("u", "v"))
        low = scratch.save(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "low")
        large = both.join(low, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        large = scratch.save(large, "large")
        low = scratch.save(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(low, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        e = scratch.save(small.where(F.col("v") != F.col("u")).distinct(), f"edges{k + 1}")
        now = _mark(e)
        if k:
            scratch.drop(f"edges{k - 1}")
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select("u", "u").distinct())
