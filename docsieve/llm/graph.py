"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Edges (u, v) have u > v. The least neighbour of a node is an aggregate; joining it back is a plain join of two shuffled tables, which adaptive execution splits at hubs."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return shared.written(moved.where("u <> v").distinct(), "edges")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has at most one smaller neighbour, and those that have one are nobody else's: then the steps have come to an end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up = 1 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), component being its smallest node. Nodes that are their own component's smallest are left out. A written table."""
    edges = shared.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_stars(edges):
        half = _star(edges, True)
        shared.discard(edges)
        edges = _star(half, False)
        shared.discard(half)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
