"""Connected components of a graph given by its links, computed in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MAX_ROUNDS = 100


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node in ``links`` (a, b: long).

    Alternating large-star and small-star steps: each step is one aggregate and
    one join on nodes, and the links shrink to stars in a number of rounds that
    grows with the logarithm of the longest path. The links of a round are
    written to the shared folder, so that a lost executor costs one round at
    most. Self links and repeats are allowed; no links give no rows.
    """
    edges = materialise(_smaller_second(links), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        edges = materialise(_small_star(materialise(_large_star(edges), "links")), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _smaller_second(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the node's smallest neighbour or itself."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that the join deals out links anew and may split those of a hub among tasks.
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
