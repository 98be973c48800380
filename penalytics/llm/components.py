"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a minimum per node (summed up before the shuffle) and a join back,
so a node with very many links is split by Spark's skew join; no node's links are
gathered in one place. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    # Staged: then both sides of the join are dealt anew, and a node with very many links is split.
    low = stage(both.groupBy("a").agg(F.min("b").alias("low")), "low")
    joined = both.join(low.select("a", F.least("a", "low").alias("low")), "a")
    if large:  # larger neighbours move to the smallest node around
        return joined.where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    moved = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a > b, longs); root: its component's smallest node."""
    links, before = stage(links.distinct(), "links"), None
    while True:
        links = stage(_star(stage(_star(links, True), "stars"), False), "links")
        print_of = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(print_of) == before:
            break
        before = tuple(print_of)
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
