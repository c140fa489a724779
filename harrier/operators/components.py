"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.storage import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable.

    links: columns a and b, in any order, repeats and loops allowed; links with
    a null end are ignored. Each step only groups and joins link rows; the
    number of steps grows with the logarithm of the longest path.
    """
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
        before = state
        both = edges.union(edges.select("b", "a"))
        low = scratch.save(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = scratch.save(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        least = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        old, edges = edges, scratch.save(small.where("a <> b").distinct())
        for t in (old, low, large, least):
            scratch.drop(t)
