"""Connected components of an undirected graph, by distributed star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.operators.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b); component is the smallest id that can be reached.

    Alternates large-star and small-star steps: each node's neighbours are hung on its smallest neighbour until
    every component is one star. A step is two aggregates and joins on the edges, written once, so a lost
    executor costs no earlier step; neighbours of a hot node are never gathered.
    """
    links = staged(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # Large star: larger neighbours of u are hung on the smallest of u and its neighbours.
        large = staged(links.join(least, links["b"] == F.col("u")).select(F.col("a"), F.col("m").alias("b"))
                       .filter(F.col("a") != F.col("b")).distinct())
        # Small star: u and its smaller neighbours are hung on the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, large["a"] == F.col("u")).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        after = staged(small.select("e.a", "e.b").filter(F.col("a") != F.col("b")).distinct())
        # Stars only: no node hangs on two, and no centre hangs on another.
        hung = after.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        loose = hung.filter(F.col("n") > 1).select("a").union(
            after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi"))
        if loose.isEmpty():
            stars = after
            break
        links = after
    centres = stars.select(F.col("b").alias("id")).distinct()
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        centres.select("id", F.col("id").alias("component")))
