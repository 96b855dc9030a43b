"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import removed, scratch_path, written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    joined = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return joined.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: numbers) but the roots; root: smallest node of its component.

    The number of edges never grows, every round is written to the shared folder, and rounds grow with the logarithm
    of the longest path. Minima are combined before they are shuffled; joins are on one key, so that a node with very
    many neighbours is split by adaptive execution. Loops and repeated edges are allowed; no edges give no rows.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, name)
    now, before = written(edges.filter("a <> b").select(a.alias("a"), b.alias("b")).distinct(), name, path), None
    # a sum of hashes without overflow tells whether the edges have changed
    mark = F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)).cast("decimal(38,0)"))
    while True:
        state = now.agg(F.count("*"), mark).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, last, path = state, path, scratch_path(spark, name)
        now = written(_small(_large(now)), name, path)
        removed(spark, last)
