"""Connected components by alternating large-star and small-star steps over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The written table (u, root) of every node of the edges (u, v): root is the smallest node reachable from u.

    Self-loops and repeated edges do no harm; without edges the result is empty.  Rounds grow with the logarithm of
    the longest path; no star is ever gathered in one place: minima are aggregates.
    """
    current = scratch.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{name}0")
    k, before = 0, None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.cut(large, f"{name}{k + 1}")
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = scratch.cut(small.filter("u <> v").distinct(), f"{name}{k + 2}")
        scratch.drop(f"{name}{k}", f"{name}{k + 1}")
        current, k = small, k + 2
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = current.select("v").distinct().select(F.col("v").alias("u"), F.col("v").alias("root"))
    out = scratch.cut(current.select("u", F.col("v").alias("root")).unionByName(roots), name)
    scratch.drop(f"{name}{k}")
    return out
