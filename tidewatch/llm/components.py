"""Connected components of a graph of 64-bit nodes by alternating stars, all of it in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can be reached.

    Each round hangs all larger neighbours of a node below its smallest one, then all smaller ones
    likewise; both are a minimum per node and a join on it.  Rounds go on until no edge changes, about
    the logarithm of the longest path; each is written to the shared folder.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    sign = _sign(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = large.join(down, large["a"] == down["n"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select(F.col("n").alias("a"), F.col("m").alias("b")))
        before, edges = edges, stored(small.filter("a <> b").distinct(), "edges")
        forget(before)
        was, sign = sign, _sign(edges)
        if sign == was:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
