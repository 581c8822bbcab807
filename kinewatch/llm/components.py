"""Connected components of a graph of long vertices, without moving it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinewatch.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns vertex and component, the smallest vertex reachable, for every vertex with an edge.

    Rounds of star contraction: every vertex points its larger neighbours, then its smaller ones, at the smallest it
    knows of, until nothing moves; the number of rounds grows with the logarithm of the longest path.
    """
    edges = settle(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.filter(F.col("a") != F.col("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = settle(small.filter(F.col("a") != F.col("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
