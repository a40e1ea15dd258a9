"""Connected components over an edge DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.session import cut


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest reachable node.

    Alternates the large-star and small-star steps, which keep the components and shrink
    every tree towards a star; it ends when a round changes nothing, after a number of
    rounds that grows with the logarithm of the longest path. Each round is checkpointed, so
    a lost executor costs one round. Null ends and self links are ignored; an empty input
    gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u links to the smallest node near u
        near = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(moved.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.union(roots).groupBy("node").agg(F.min("component").alias("component"))
