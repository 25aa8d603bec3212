"""Connected components of a table of links, in rounds of bounded work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long) to (node long, root long), root being the least node.

    Alternates large-star and small-star rounds until the links are stars. A round
    sends each link a constant number of times and keeps no neighbour list in one
    place: minima are pre-aggregated, and the join that hands them out is a plain
    equi-join, which adaptive execution splits at hubs. Nodes without a link to
    another node are not returned. Loops and repeated links are allowed.
    """
    now = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while True:
        large = _star(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), large=True)
        small = _star(large, large=False)
        new = materialise(small.distinct(), "links")
        before, state = state, _state(new)
        discard(now)
        now = new
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _star(both: DataFrame, large: bool) -> DataFrame:
    """large: both has each link both ways; greater neighbours go to a node's minimum.
    Else both has links (greater, less); lesser neighbours and the node itself do."""
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    joined = both.join(least, "a")  # with a table, so that it can be split at a hub
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
