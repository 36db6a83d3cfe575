"""Connected components as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.functions.shared import delete, written


def min_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Star contraction: in turn, each node hands its larger neighbours to its smallest one, and its
    smaller ones to the smallest of these. The stars are done when a round changes nothing; rounds
    grow with the logarithm of the longest path. Every result is written down, so lineage stays short,
    both sides of each join come from a scan, and a hub's rows can be split; the tables of a round
    are deleted once the next is written. Edges with a null end, and of a node with itself, link nothing.
    """
    spark, last, now = edges.sparkSession, [], []
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", last)
    size = edges.count()
    while size:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", now)
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", now)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least", now)
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        kept: list[str] = []
        small = written(small.where("u != v").distinct(), "edges", kept)
        n = small.count()
        done = n == size and small.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges, size = small, n
        delete(spark, last)
        delete(spark, now)
        last = kept
        if done:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
