"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, keep: list[str]) -> DataFrame:
    """edges (a, b: long) to node, component: the least node that can be reached. Nodes without links aren't listed.

    A round is two group-wise minima and joins on keys, so no group is gathered; the number of rounds grows with the
    logarithm of the longest chain. Each round's table is settled and the one before dropped."""
    held: list[str] = []
    now = common.settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), held)
    seen = _state(now)
    while True:
        old, held = held, []
        # large star: every larger neighbour of a node points to the least of its neighbourhood
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        now = common.settle(star.select("x.*").filter("a <> b").distinct(), held)
        common.drop(edges.sparkSession, old)
        if (state := _state(now)) == seen:
            break
        seen = state
    keep += held
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
