"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgcurate.session import written


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other at most, on which others hang only if it hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.where("hangs + holds > 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node in a link: the smallest node reachable.

    Links are re-hung on the smallest neighbour, first from larger neighbours, then from
    smaller ones, until every node hangs on its component and nothing hangs on it. The rounds
    grow as the logarithm of the longest path; links that are stars already need none. Only
    minima are grouped; each round is written to the shared folder.
    """
    edge = lambda df: df.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edge(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")), "least")
        hung = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        hung = written(edge(hung.unionByName(least.select("a", F.col("least").alias("b")))), "hung")
        least = written(hung.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = hung.join(least, "a").select("b", "least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = written(edge(small.unionByName(least.select("a", F.col("least").alias("b")))), "links")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
