"""Connected components of a link table, kept in DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links that one task takes.
ROWS = 50_000


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; the component is the smallest node that can be reached.

    Links are rewired until they are stars: each node's larger neighbours are hung on its smallest one, and then the smaller
    neighbours, in turn (large-star, small-star). Each step is a map-side minimum and a join on one node, which Spark can
    split when a node has very many links; the rounds grow with the logarithm of the size. Every round is written to the
    checkpoint folder, which cuts the plan and survives lost executors; it runs in as many tasks as its links fill, ROWS
    each, so that small tables don't leave a file for every one of Spark's partitions. An empty table gives no rows.
    """
    links = links.select(F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi")).where("lo < hi").distinct().checkpoint()
    while True:
        tasks = links.count() // ROWS + 1
        links = links.coalesce(tasks)
        # Large star: over both directions, larger neighbours of u go to the smallest node around u.
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").coalesce(tasks).select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct().coalesce(tasks)
        # Small star: the smaller neighbours of u, and u, go to the smallest of them.
        small_least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).coalesce(tasks)
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(small_least, "u").coalesce(tasks)
        new = small.select(F.col("m").alias("lo"), F.col("v").alias("hi")).union(small_least.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).where("lo < hi").distinct().coalesce(tasks).checkpoint()
        # Stars: no node is both a centre and a leaf, and no leaf has two centres.
        leaves = new.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
        open_ = leaves.where("n > 1").select("hi").union(leaves.select("hi").join(new.select(F.col("lo").alias("hi")), "hi", "left_semi"))
        links = new
        if open_.isEmpty():
            break
    leaf = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return leaf.union(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
