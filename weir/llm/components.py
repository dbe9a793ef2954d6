"""Connected components of an edge list, by min-label contraction with written intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of ``edges`` (a, b).

    Each round links every node's greater neighbours, then its smaller ones, to the smallest of them (the star contraction of
    Kiveris and others, 2014), until nothing changes; the number of rounds grows with the logarithm of the longest path.
    Pairs and labels stay in tables; only a count reaches the driver.
    """
    both = edges.select("a", "b").where("a <> b")
    pairs = written(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    while True:
        # large star: the greater neighbours of u go to the smallest node around u
        around = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "pairs")
        same = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        pairs = new
        if same:
            break
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
