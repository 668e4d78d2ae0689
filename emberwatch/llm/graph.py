"""Connected components by alternating star contraction, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _are_stars(edges: DataFrame) -> bool:
    """Every larger end has one smaller end, which is no larger end itself."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.filter((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every vertex of ``edges`` (columns a, b).

    Every vertex turns to the least of its neighbours: larger neighbours first, then smaller ones, until
    only stars are left, which takes a logarithmic number of rounds. Only least values are gathered per
    vertex, combined before the shuffle; the edges of a busy vertex are never brought together.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges", small=True)
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # larger neighbours of a vertex go to its least neighbour
        large = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).filter("a <> b").distinct()
        # so do its smaller neighbours, and the vertex itself
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "edges", small=True)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
