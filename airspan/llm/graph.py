"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airspan.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b).

    Large-star and small-star rounds until nothing changes. A round is two aggregates of the
    edges, whose partial minima are combined before the shuffle, and joins on node keys; the
    number of edges never grows. Only a count and a checksum of each round reach the driver.
    """
    links = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a != b").distinct())
    before = None
    while True:
        # Large star: larger neighbours go to the smallest node around.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Small star: smaller neighbours and the node itself go to its smallest neighbour.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        links = durable(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.groupBy("a").agg(F.min("b").alias("component")).select(
        F.col("a").alias("node"), "component").unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy(
        "node").agg(F.min("component").alias("component"))
