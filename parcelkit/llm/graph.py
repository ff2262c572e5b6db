"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_sized

#: Edges of a partition, about.
EDGES = 1 << 14


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b: long, not null).

    Each round ties every node's larger neighbours to the smallest node around it, then its smaller
    neighbours likewise; after a number of rounds that grows with the logarithm of the longest path
    every edge points to its component's smallest node. A node's smallest neighbour comes from a
    map-side minimum; the edges of a node with many of them meet it by broadcast, so no task gets all
    the neighbours of one node. Tables are kept in partitions of about EDGES rows, so few edges make few files.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    n, state = edges.count(), None
    while True:
        parts = max(1, -(-n // EDGES))  # a round never adds edges
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        larger = durable(join_sized(both.where("v > u"), least, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(parts))
        least = larger.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        smaller = join_sized(larger, least, ["u"], "n", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = durable(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        n, *now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, *now) == state:
            break
        state = (n, *now)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
