"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of numbers to (node, root): root is the smallest node that links reach from node.

    Only nodes with a link to another node are returned.  Each step needs minima of neighbours (combined before the shuffle)
    and joins on a node, which Spark splits where a node has very many links; no node's links are gathered.  Every step is
    a written table, so a lost executor never replays earlier steps.
    """
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    now = written(edges.select(pair(F.col("a"), F.col("b")).alias("e")).select("e.*").where("a < b").distinct(), "cc")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        root = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(root, "x").select(pair(F.col("y"), F.col("m")).alias("e")).select("e.*").where("a < b")
        new = written(small.union(root.select(F.col("m").alias("a"), F.col("x").alias("b"))).distinct(), "cc")
        dropped(now)
        now, before = new, seen
        seen = mark(now)
        if seen == before:
            break
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.union(now.select(F.col("a"), F.col("a")).distinct())
