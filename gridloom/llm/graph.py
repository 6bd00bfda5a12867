"""Connected components by alternating large and small stars, on tables cut at every step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for all nodes of an edge but the roots themselves.

    Loops, nulls and repeated edges are ignored; no edges give an empty table. Each step takes a
    minimum by node (combined before the shuffle) and joins it back as a table written anew, so
    that a hub's edges can be split over tasks. No edge or label reaches the driver, only a
    checksum that tells when the edges stop changing.
    """
    clean = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now, mark, step = scratch.table(clean, "edges0"), None, 0
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a))")).first()
        if seen[0] == 0 or tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, step = tuple(seen), step + 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"least{step}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, f"large{step}")
        least2 = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), f"lower{step}")
        moved = large.join(least2, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.table(moved.union(least2.select("a", F.col("m").alias("b"))).distinct(), f"edges{step}")
        scratch.drop(f"least{step}", f"large{step}", f"lower{step}", f"edges{step - 1}")
