"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (a, b).

    Alternates large-star and small-star steps: each links every node to the
    smallest node it knows, through aggregates and joins only, and is written to
    the shared folder. The edges stop changing after a number of steps of the
    order of the logarithm of the longest path."""
    edges = stored(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())

    def star(near: DataFrame, larger_only: bool) -> DataFrame:
        # near: (node, other); every node's smallest neighbour, itself included
        least = near.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
        moved = near.join(least, "node")
        if larger_only:
            return moved.where("other > node").select(F.col("least").alias("lo"), F.col("other").alias("hi"))
        return (moved.select(F.col("least").alias("lo"), F.col("other").alias("hi"))
                .unionByName(least.select(F.col("least").alias("lo"), F.col("node").alias("hi"))))

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    before = state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionByName(
            edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")))
        edges = star(both, True).where("lo < hi").distinct()
        down = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        edges = stored(star(down, False).where("lo < hi").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return stored(nodes.unionByName(roots))
