"""Connected components of an edge table, by alternating large and small stars.

Defined results: an edge from a node to itself, or given twice or both ways, adds nothing; a node without another's edge is
not in the result; an empty table gives an empty result; nulls are not nodes and are for the caller to leave out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelore.llm.common import discard, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest neighbour. ``edges``: u, v with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    lowest = stage(lowest, "lowest")  # a table of its own, so that adaptive execution may split a hot node in the join
    joined = both.join(lowest, "u")
    moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (columns a, b)."""
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    last = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if (state.n, state.h) == last or not state.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct().toDF("node", "component"))
        last = (state.n, state.h)
        hung = stage(_star(now, large=True), "stars")
        new = stage(_star(hung, large=False), "stars")
        discard(now, hung)
        now = new
