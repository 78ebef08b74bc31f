"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long, not null) that isn't itself the smallest of its component.

    Every round is grouped minima and equi-joins, which Spark pre-aggregates and splits where a node has many links; the
    edges of a round are written to the shared folder, so a lost executor repeats part of one round at most. Rounds grow
    as the logarithm of the longest chain. The driver sees a count and a sum.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stage(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y")).where("x <> y")
        small = small.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        e = stage(small, "edges")
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
