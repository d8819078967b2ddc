"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import settle


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with an aggregate's result so that a hot key of ``left`` can be split at run time.

    Adaptive skew handling needs an exchange of its own on either side; joining on a hash of the keys
    beside the keys keeps the aggregate's partitioning from standing in for it.
    """
    mark = F.xxhash64(*keys).alias("__mark")
    return left.select("*", mark).join(right.select("*", mark), ["__mark", *keys], how).drop("__mark")


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, root)``: every node but the roots, with its smallest reachable id.

    Each round turns every neighbourhood into a star around its smallest id, first for larger neighbours,
    then for smaller ones; the number of rounds grows with the logarithm of the longest path. A round
    aggregates minima before it joins them, and its result is settled in the shared folder.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = split_join(both.filter("b > a"), low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Now every edge runs from a node to a smaller one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, least, ["a"])
        edges = settle(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))
        ).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
