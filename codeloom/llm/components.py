"""Connected components by alternating stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import drop, written


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node that has a link. links: columns a and b, longs that aren't null.

    A round turns each node's larger neighbours, then its smaller ones, towards its least neighbour; the edges are
    stars after a number of rounds that grows with the logarithm of the longest chain. Only edges are shuffled,
    after partial minima, and no group is ever collected.
    """
    spark = links.sparkSession
    edges, path = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(edges):
        # each half round is written, so plans stay small however many rounds there are
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large, large_path = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # every edge now points down: a node's neighbours below, turned to the least of them
        lowest, lowest_path = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, new = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for old in (path, least_path, large_path, lowest_path):
            drop(spark, old)
        path = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with one edge to one without any that leads on."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or (up = 1 and root = 1)").isEmpty()
