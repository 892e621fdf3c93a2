"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first()
    return r[0], r[1]


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): link neighbours of u to the smallest of u and its neighbours. The smallest is summed up before the
    shuffle; the join back is an ordinary equi-join, whose hot partitions adaptive execution splits."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        own = low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of non-null longs -> (node, component): the smallest node reachable from each node that has a link."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = _signature(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _star(both, True)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = cut(_star(down, False))
        after = _signature(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
