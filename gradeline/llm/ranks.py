"""Positions in a global order, from sorted ranges and the totals before each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.session import checkpointed

ROWS_PER_RANGE = 500_000


def in_order(df: DataFrame, keys: list[str | Column], weight: str | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with ``position`` (from 0, long) in the order of ``keys`` and, for ``weight``, ``before``: its sum over all earlier rows.

    ``df`` must be cheap to read again (a stored table). Rows are dealt into ranges of about ``rows_per_range`` rows (fewer for wide keys), sorted and
    stored, so the cut of the ranges cannot move between the totals and the rows; only one row per range meets in one task. Rows
    that are equal in all keys stand next to each other in either order. Helper columns start with two underscores.
    """
    parts = max(1, -(-df.count() // rows_per_range))
    ranged = checkpointed(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()))
    sums = [F.count(F.lit(1)).alias("__part_rows")] + ([F.sum(weight).alias("__part_sum")] if weight else [])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*sums).select(
        "__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__part_rows", "__part_sum")[: len(sums)]])
    joined = ranged.join(F.broadcast(totals), "__part")  # one row for each range
    position = (F.col("__part_rows") + F.col("__place").bitwiseAND((1 << 33) - 1)).alias("position")
    out = [*df.columns, position]
    if weight:
        running = F.sum(weight).over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))
        out.append((F.col("__part_sum") + F.coalesce(running, F.lit(0))).alias("before"))
    return joined.select(*out)


def lowest_hashed(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of ``df``: those of lowest hash of ``keys``, ties in the order of ``keys``.

    ``df`` must be cheap to read twice. A first cut at a hash that about 1.5 times as many rows lie under keeps what the tasks
    send on in proportion to ``most``, not to their number.
    """
    hashed = df.withColumn("__hash", F.xxhash64(*keys))
    count = df.count()
    if count > 2 * most:
        hashed = hashed.where(F.col("__hash") < int(-(2**63) + 1.5 * most / count * 2**64))
    return hashed.orderBy("__hash", *keys).limit(most).drop("__hash")
