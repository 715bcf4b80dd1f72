"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import keep, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns a, b); the
    component is its smallest node. Each round groups by node for a minimum
    only (a partial aggregation) and joins it back, so the neighbours of a
    node are never gathered. Rounds grow with the logarithm of the longest
    path. An empty table gives no rows."""
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: larger neighbours move to the smallest node around
        large = (both.join(least, "a").filter("b > a and b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: smaller neighbours do
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .unionByName(least.withColumnRenamed("m", "b")).distinct())
        new = keep(small, "edges")
        release(now)
        now = new
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (found["n"], found["h"]) == mark:
            break
        mark = (found["n"], found["h"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
