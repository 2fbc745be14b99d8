"""Running totals and exact quantiles over a global order, without a single-task window."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gradeline.session import checkpointed

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 20_000


def range_bounds(df: DataFrame, score: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Cut points that split the score axis into ranges of about ``rows_per_range`` rows.

    One small aggregate reaches the driver: a count, then at most MAX_RANGES quantiles.
    A repeated cut point means one score holds more than a range of rows.
    """
    rows = df.select(score).count()
    ranges = min(MAX_RANGES, math.ceil(rows / rows_per_range))
    if ranges <= 1:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(score, shares, max(10_000, 10 * ranges)).alias("q")).first()["q"]
    return [float(cut) for cut in cuts]


def with_range(df: DataFrame, score: str, bounds: Sequence[float], name: str = "_range") -> DataFrame:
    """Number of distinct cut points at or below the score: a deterministic range number."""
    cuts = sorted(set(bounds))
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [-math.inf, *cuts, math.inf]
    bucketizer = Bucketizer(splits=splits, inputCol=score, outputCol=name)
    return bucketizer.transform(df).withColumn(name, F.col(name).cast("int"))


def running_totals(
    groups: DataFrame,
    order: str,
    totals: Mapping[str, str],
    by: Sequence[str] = (),
    bounds: Sequence[float] = (),
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums (new name -> summed column) in the order of ``order`` inside ``by``.

    ``groups`` holds one row per (by, order) value. Every range is summed first, the bounded
    table of range sums gives each range its starting point, and only the rows of one range
    meet in one task.
    """
    by = list(by)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*by, "_range").orderBy(direction).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranged = with_range(groups, order, bounds)
    if not bounds:
        out = ranged.select("*", *[F.sum(c).over(inside).alias(n) for n, c in totals.items()])
        return out.drop("_range")
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    before = Window.partitionBy(*by).orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    if not by:
        before = Window.orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
        .select(*by, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in totals])
    )
    joined = matched(ranged, starts, [*by, "_range"])
    return joined.select(
        *groups.columns, *[(F.sum(c).over(inside) + F.col(f"_s_{n}")).alias(n) for n, c in totals.items()])


def global_rank(
    df: DataFrame, order: Sequence[str], totals: Mapping[str, str] | None = None, partitions: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Row-level rank (1-based ``rank``) and running sums in a composite order that ends in a unique key.

    The rows are range-partitioned by the whole order, so even one hot score spreads over many
    tasks. The ranged rows are checkpointed: range cut points come from a sample, and both the
    totals and the rows have to see the same cut.
    """
    totals = dict(totals or {})
    by = list(by)
    order = [*by, *order]
    partitions = partitions or max(1, math.ceil(df.count() / ROWS_PER_RANGE))
    ranged = checkpointed(
        df.repartitionByRange(partitions, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    before = (Window.partitionBy(*by) if by else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s_n"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in totals])
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return matched(ranged, starts, [*by, "_range"]).select(
        *df.columns, (F.row_number().over(inside) + F.col("_s_n")).cast("long").alias("rank"),
        *[(F.sum(c).over(upto) + F.col(f"_s_{n}")).alias(n) for n, c in totals.items()])


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), bounds: Sequence[float] | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per group: rows (by..., prob, quantile).

    Distinct values are counted first and ranked with ``running_totals``, so no task keeps a
    value histogram of the whole column in memory.
    """
    by = list(by)
    present = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    counts = present.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, "_x", {"_cum": "_n"}, by, range_bounds(present, "_x") if bounds is None else bounds)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_size"))
    ranked = attach(ranked, sizes, by)
    asked = F.array(*[F.struct(F.lit(float(p)).alias("prob"), ((F.col("_size") - 1) * F.lit(float(p))).alias("h"))
                      for p in probs])
    low, high = F.floor("_p.h"), F.ceil("_p.h")
    covers = lambda k: (k >= F.col("_cum") - F.col("_n")) & (k < F.col("_cum"))
    hits = ranked.select(*by, "_x", "_n", "_cum", F.explode(asked).alias("_p")).filter(covers(low) | covers(high))
    return (
        hits.groupBy(*by, F.col("_p.prob").alias("prob"))
        .agg(F.max(F.when(covers(low), F.col("_x"))).alias("_lo"), F.max(F.when(covers(high), F.col("_x"))).alias("_hi"),
             F.max(F.col("_p.h") - low).alias("_f"))
        .select(*by, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"))
    )


def exact_medians(rows: DataFrame, columns: Sequence[str], by: str, near: float = 0.002) -> dict:
    """{(group, column): interpolated median} of double columns without NaN; a column without a value in a group is left out.

    Sketches (off by a ten-thousandth of the rows at most) bracket every median, then the rows below a bracket are counted and only the
    values inside it, about 2 * ``near`` of the rows, are grouped and ranked. Two scans, whatever the number of columns.
    """
    shares = [0.5 - near, 0.5 + near]
    sketches = rows.groupBy(by).agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q_{c}") for c in columns], *[F.count(c).alias(f"n_{c}") for c in columns])
    found = [(r[by], c, *r[f"q_{c}"], r[f"n_{c}"]) for r in sketches.collect() for c in columns if r[f"n_{c}"]]  # one row per group
    if not found:
        return {}
    schema = StructType([StructField("_by", rows.schema[by].dataType), *StructType.fromDDL("_column string, _lo double, _hi double, _size bigint").fields])
    brackets = F.broadcast(rows.sparkSession.createDataFrame(found, schema))
    long = rows.select(by, *columns).unpivot([by], list(columns), "_name", "_x")
    inside = long.join(brackets, (F.col("_name") == F.col("_column")) & F.col(by).eqNullSafe(F.col("_by")) & (F.col("_x") <= F.col("_hi")))
    counts = inside.groupBy("_by", "_column", "_size", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_by", "_column").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = (F.col("_size") - 1) / 2
    covers = lambda k: (k >= F.col("_cum") - F.col("_n")) & (k < F.col("_cum"))
    hits = counts.withColumn("_cum", F.sum("_n").over(upto)).groupBy("_by", "_column").agg(
        F.max(F.when(covers(F.floor(half)), F.col("_v"))).alias("lo"), F.max(F.when(covers(F.ceil(half)), F.col("_v"))).alias("hi"),
        F.max(half - F.floor(half)).alias("f"))
    return {(r["_by"], r["_column"]): r["lo"] + (r["hi"] - r["lo"]) * r["f"] for r in hits.collect()}


def attach(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join group totals back; with no group columns the totals are exactly one row."""
    return matched(df, totals, by) if by else df.join(F.broadcast(totals))


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which a missing key equals a missing key, so rows of a NULL group stay."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]).drop(*[f"_right_{k}" for k in keys])
