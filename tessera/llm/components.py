"""Connected components of an edge table, by large-star and small-star steps.

Each round links the neighbours of a vertex to the smallest vertex it knows;
the rounds end when the edges are stars. Only whether they are reaches the driver. The
smallest neighbours are written before they are joined, so that the join of a vertex with
many edges, a plain shuffle on both sides, can be split.

Ties: equal edges are one. An empty edge table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(v, component)`` of every vertex on an edge ``(a, b)``; the component's id is its smallest vertex.

    Edges with a null end or from a vertex to itself are ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialized(edges, "edges")
    for _ in range(max_rounds):
        if _stars(edges):
            break
        edges = materialized(_small_star(_large_star(edges)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = edges.select(F.col("u"), F.col("v"))
    return leaves.union(leaves.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("v"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end, which no round changes."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex moves to the smallest in its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialized(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and itself, move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialized(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
