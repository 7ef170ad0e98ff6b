"""Connected components of a graph, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.sources import stored


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours are tied to the smallest node around, the node itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, are tied to the smallest of them. Edges lead from the larger node a to the smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ties = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return ties.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of edges (a, b); edges with a null end and loops are left out.

    Every round is a table in the shared folder; it ends when a round changes nothing, after about the square of the logarithm of the
    nodes at most. No task holds a component: minima are aggregates, and the ties of a large star are rows of a join."""
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        state = stored(_small(_large(state)), "stars")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
