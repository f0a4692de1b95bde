"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.sources.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is its smallest node.

    Each round links a node's larger neighbours (large star), then its smaller
    ones (small star), to the smallest, until every node has one link to a node
    that has none; rounds needed grow with the logarithm of the longest chain.
    Each is written out, so lost executors cost a round.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "low"), F.struct("a", "low"))).alias("s"))
        edges = cut_lineage(small.select(F.col("s.a").alias("a"), F.col("s.low").alias("b")).where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node is linked to one smaller node that is linked to none; another round would change nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").count() == 0
