"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregate (with a partial one before the shuffle) and a join that Spark may split
where a hub is hot.  The lineage is cut by ``checkpoint()`` once a round; two numbers of a round
reach the driver.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v) with v a neighbour of u -> the same with least neighbour m of u, u itself included.  The
    least neighbours are a plain side of the join, so that Spark can split the rows of a hub."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).checkpoint()
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a and b of one orderable type; the result has node and least (the least
    node of its component) for every node of an edge.  Self-links and null ends are ignored."""
    common.shared_folder(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u over its smaller neighbours
        stars = _stars(large)
        small = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(stars.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("least"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(roots)
