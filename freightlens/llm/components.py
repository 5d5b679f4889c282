"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and sums of two hashes of them: equal for equal edges."""
    one = lambda seed: F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), one(1), one(2)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the smallest node it is connected to.

    Each step is a grouped minimum and a join; the edges are written to the shared folder after a pair of
    steps. The number of rounds grows with the logarithm of the component size.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    state = _digest(edges)
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = _pairs(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        edges, before, state = after, state, _digest(after)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
