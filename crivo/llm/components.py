"""Connected components of a table of edges, by min-label stars, with a stored table in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id that has an edge.

    ``edges`` holds columns ``a`` and ``b`` (long, no nulls), in any direction,
    repeats and loops allowed. Every round hangs each node under the smallest
    neighbour of its neighbourhood (large star, then small star); the number of
    edges never grows, and rounds follow the logarithm of the longest path. A
    node with very many neighbours is only ever reduced by a minimum, which is
    taken before the shuffle, and by joins that Spark may split.
    """
    links = common.stored(_tidy(edges.select("a", "b")), "links")
    before = None
    while True:
        links = common.stored(_small_star(_large_star(links)), "links")
        state = tuple(links.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")),
                                F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            break
        before = state
    # all that is left: a -> b, where b is the smallest of its component
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("component"))
    ).distinct()


def _tidy(links: DataFrame) -> DataFrame:
    """Larger id first, no loops, no repeats."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Hangs each larger neighbour of a node under the smallest id of the node's neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _tidy(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Hangs the smaller neighbours of a node, and itself, under the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return _tidy(
        links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    )
