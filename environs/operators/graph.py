"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, stash


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> node, root (the smallest node of its component), by alternating large and small stars.

    After Kiveris et al., 2014: rounds grow with the logarithm of the number of nodes. Minima are combined before the shuffle, each
    round is written to the shared folder, and the round before it is deleted. A round that changes nothing, and edges that are
    stars already, end it. Every node with an edge has a row, roots too; loops are dropped. The result reads one table, which ``drop`` takes.
    """
    e = stash(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "stars")
    while not _are_stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        after = stash(small.distinct(), "stars")
        drop(e)
        e = after
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
    out._environs_table = vars(e).get("_environs_table")
    return out


def _are_stars(e: DataFrame) -> bool:
    """Each u has one v, and no v is a u: every node points to its root."""
    below = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    if below.where("n > 1").limit(1).count():
        return False
    return not e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
