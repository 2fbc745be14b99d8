"""Connected components of a link table, as alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.session import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (x, y), both long; root is the smallest node it can be reached from.

    Each round points every node's larger neighbours at its smallest one (large star), then every node and its smaller
    neighbours at the smallest of them (small star). Minima combine before the shuffle, joins stay splittable, and every
    round is cut off through the checkpoint folder; the number of rounds grows with the logarithm of the longest chain.
    Empty input gives an empty table; loops and repeated links are ignored.
    """
    larger, smaller = F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")
    edges = checkpointed(edges.where("x <> y").select(larger, smaller).distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        lowest = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(lowest, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        lowest = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(lowest, "x")
        small = joined.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(
            lowest.select("x", F.col("m").alias("y")))
        edges = checkpointed(small.where("x <> y").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(
        edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
