"""Connected components of an edge table, by alternating star contractions over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node with an edge (a, b: long); comp is the component's smallest node.

    Large star: a node's larger neighbours are joined to its smallest one; small star: the smaller ones are. Hubs are
    met by a minimum with map-side combining and a join that may be split, never by collecting a node's neighbours. The
    rounds grow with the logarithm of the longest path.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        new = staged(small.where("a <> b").distinct())
        size = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        done = tuple(size(new)) == tuple(size(edges))
        edges = new
        if done:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
