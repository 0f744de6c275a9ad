"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def components(edges: DataFrame, keep=written) -> DataFrame:
    """node, component (the least node reachable) of every node of ``edges`` (a, b: longs).

    Each step rewrites edges towards the least neighbour with a grouped minimum (combined before its shuffle) and a join
    that adaptive execution may split; no node's neighbours meet in one task.  Steps end when the edges are stars: no node
    has an edge to a lesser one and to a greater one.  Null ends and loops are ignored; no edges give no rows.  ``keep``
    writes the edges of a step (by default :func:`~.shared.written`).
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() or not _single(e):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large, "star")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = keep(stars, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _single(e: DataFrame) -> bool:
    """Whether every node has one edge to a lesser one at most."""
    return e.groupBy("u").agg(F.count("*").alias("k")).where("k > 1").isEmpty()
