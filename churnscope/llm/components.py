"""Connected components of a link table, by alternating large-star and small-star steps.

Every node ends up linked to the smallest id it can reach.  A step is one aggregation (with partial sums, so a
node with very many links is no hot group) and one join on the node, and no task or driver ever holds
a component.  Steps are written to the shared folder; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(links: DataFrame, name: str) -> DataFrame:
    """links: (u, v), each way that counts.  Every v gets the smallest of u and u's neighbours: (a, b), a > b."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    near = links.join(least, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("low").alias("b"))
    return materialise(near.unionByName(own).filter("a > b").distinct(), name)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): for links (a long, b long), the smallest id reachable from each linked id."""
    now = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        big = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = big.unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: only neighbours above a node move; those below meet their own minimum
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()
        now = _star(materialise(large, "large").select(F.col("a").alias("u"), F.col("b").alias("v")), "small")
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if state == sums:
            break
        state = sums
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
