"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_by_key, materialize


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Join each node's larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return join_by_key(both, least, "a", "n", 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Join each node's smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    near = join_by_key(edges, least, "a", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node of edges (a > b, longs, no nulls) and the smallest node it reaches.

    Each round is two joins on the edges, written to the shared folder; only
    its count and checksum reach the driver. It ends when a round changes
    nothing, that is, when every component is a star at its smallest node. The
    edges of a node of very many are not gathered in one task.
    """
    seen, n = None, edges.count()
    for _ in range(most_rounds):
        large = materialize(_large_star(edges, n), "stars")
        edges = materialize(_small_star(large, large.count()), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        n = state[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
