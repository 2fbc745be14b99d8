"""Chronological splits, roles and expanding-window folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeline.functions.columns import is_month, month_number
from gradeline.functions.sampling import hash_digits
from gradeline.operators.checks import check_rows
from gradeline.operators.ordering import attach
from gradeline.session import checkpointed


def range_table(spark: SparkSession, ranges: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """A bounded settings table (role, split, first_month, last_month)."""
    return spark.createDataFrame(list(ranges), "role string, split string, first_month string, last_month string")


def range_checks(ranges: DataFrame) -> DataFrame:
    """Well-formed months, no reversed range, no gap and no overlap inside a split."""
    following = F.lead("first_month").over(Window.partitionBy("split").orderBy("first_month"))
    steps = ranges.withColumn("_step", month_number(following) - month_number(F.col("last_month")))
    return check_rows(steps.agg(
        F.count_if(~is_month(F.col("first_month")) | ~is_month(F.col("last_month"))).alias("bad_month"),
        F.count_if(F.col("first_month") > F.col("last_month")).alias("reversed_range"),
        F.count_if(F.col("_step") < 1).alias("overlap"), F.count_if(F.col("_step") > 1).alias("gap")),
        ["bad_month", "reversed_range", "overlap", "gap"])


def split_column(month: Column, ranges: Sequence[tuple[str, str, str]]) -> Column:
    """Split name by inclusive month range; an unmapped month is NULL and fails a check."""
    out = None
    for name, first, last in ranges:
        inside = month.between(first, last)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def role_matches(split: Column, month: Column, ranges: Sequence[tuple[str, str, str, str]]) -> Column:
    """Names of every role whose split and month range hold the row."""
    return F.array_compact(F.array(*[
        F.when((split == s) & month.between(first, last), F.lit(role)) for role, s, first, last in ranges]))


def assign_roles(rows: DataFrame, ranges: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Adds ``role`` (NULL without a single match) and ``role_count``."""
    matched = rows.withColumn("_roles", role_matches(F.col("split"), F.col("issue_month"), ranges))
    return matched.select(
        *rows.columns, F.when(F.size("_roles") == 1, F.get("_roles", F.lit(0))).alias("role"),
        F.size("_roles").alias("role_count"))


def role_profile(rows: DataFrame, by: str = "role") -> DataFrame:
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("target").cast("long").alias("events"), F.avg("target").alias("event_rate"),
        F.min("issue_month").alias("first_month"), F.max("issue_month").alias("last_month"))


def month_blocks(rows: DataFrame, folds: int, min_fit_share: float) -> DataFrame:
    """Each month's holdout block by the cumulative row share at its midpoint, -1 for fit-only months.

    The window runs over one row per calendar month, never over data rows.
    """
    months = rows.groupBy("issue_month").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.orderBy("issue_month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    share = (F.sum("rows").over(upto) - F.col("rows") / F.lit(2.0)) / F.sum("rows").over(every)
    scaled = (F.col("share") - F.lit(min_fit_share)) / F.lit(1 - min_fit_share) * F.lit(folds)
    return months.withColumn("share", share).withColumn(
        "block", F.when(F.col("share") > min_fit_share, F.least(F.floor(scaled), F.lit(folds - 1))).otherwise(F.lit(-1)).cast("int"))


def fold_ranges(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("block") >= 0).groupBy(F.col("block").alias("fold")).agg(
        F.min("issue_month").alias("first_month"), F.max("issue_month").alias("last_month"))


def fold_months(blocks: DataFrame) -> DataFrame:
    """(fold, part, issue_month): every fold's fit and holdout months.

    At most one row per calendar month, fold and part, so the table is bounded by the calendar.
    """
    months = blocks.select("issue_month", "block")
    ranges = F.broadcast(fold_ranges(blocks))
    earlier = months.join(ranges, F.col("issue_month") < F.col("first_month")).select(
        "fold", F.lit("fit").alias("part"), "issue_month")
    held = months.filter(F.col("block") >= 0).select(
        F.col("block").alias("fold"), F.lit("holdout").alias("part"), "issue_month")
    return earlier.unionByName(held)


def expanding_folds(rows: DataFrame, folds: int, min_fit_share: float) -> DataFrame:
    """Rows repeated once per (fold, part) they belong to; fit months all precede the holdout."""
    months = fold_months(month_blocks(rows, folds, min_fit_share))
    return rows.join(F.broadcast(months), "issue_month")


def fold_table(long: DataFrame) -> DataFrame:
    """Fit and holdout rows and month ranges per fold."""
    fit, held = F.col("part") == "fit", F.col("part") == "holdout"
    return long.groupBy("fold").agg(
        F.count_if(fit).alias("fit_rows"), F.count_if(held).alias("holdout_rows"),
        F.max(F.when(fit, F.col("issue_month"))).alias("last_fit_month"),
        F.min(F.when(held, F.col("issue_month"))).alias("first_holdout_month"),
        F.max(F.when(held, F.col("issue_month"))).alias("last_holdout_month"))


def fold_checks(long: DataFrame, folds: int) -> DataFrame:
    """Empty parts, fit months not before the holdout, ids in both parts, ids held out twice."""
    table = fold_table(long)
    months = table.agg(
        (F.lit(folds) - F.count_if((F.col("fit_rows") > 0) & (F.col("holdout_rows") > 0))).alias("empty_folds"),
        F.count_if(F.col("last_fit_month") >= F.col("first_holdout_month")).alias("fit_not_before_holdout"))
    per_id = long.groupBy("loan_id", "fold").agg(
        F.count_if(F.col("part") == "fit").alias("_fit"), F.count_if(F.col("part") == "holdout").alias("_held")
    ).groupBy("loan_id").agg(F.count_if((F.col("_fit") > 0) & (F.col("_held") > 0)).alias("_both"), F.sum("_held").alias("_h"))
    ids = per_id.agg(F.coalesce(F.sum("_both"), F.lit(0)).alias("fit_and_holdout"),
                     F.count_if(F.col("_h") > 1).alias("held_out_twice"))
    return check_rows(months, ["empty_folds", "fit_not_before_holdout"]).unionByName(
        check_rows(ids, ["fit_and_holdout", "held_out_twice"]))


_DIGIT = 20


def stratified_cuts(drawn: DataFrame, wanted: DataFrame, by: str = "target") -> DataFrame:
    """(by, n, cut): for every class the draw below or at which exactly its ``n`` lowest rows lie (-1 for none).

    Radix selection on 60-bit draws, twenty bits at a time: counts per class and digit give the digit in which the n-th row lies,
    and only rows of that digit are counted again. No row is sorted; a count table has at most 2**20 digits per class and cut. Draws
    must differ, as those of unique keys do.
    """
    state = wanted.select(by, "n", F.col("n").alias("left"), F.lit(0).cast("long").alias("prefix"))
    digits = drawn.select(F.col(by).alias("_by"), "_d")
    for shift in (2 * _DIGIT, _DIGIT, 0):
        inside = digits.join(F.broadcast(state.where("left > 0")), F.col("_by").eqNullSafe(F.col(by)) & (F.shiftright("_d", shift + _DIGIT) == F.col("prefix")))
        counts = inside.groupBy(by, "n", "left", F.shiftright("_d", shift).alias("digit")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(by, "n").orderBy("digit"))
        hit = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("left")) & (F.col("_upto") - F.col("_c") < F.col("left")))
        found = checkpointed(hit.select(by, "n", (F.col("left") - F.col("_upto") + F.col("_c")).alias("left"), F.col("digit").alias("prefix")))
        state = found  # one row per class and cut
    none = wanted.where("n <= 0").select(by, "n", F.lit(-1).cast("long").alias("cut"))
    return state.select(by, "n", F.col("prefix").alias("cut")).unionByName(none)


def stratified_folds(rows: DataFrame, key: str, folds: int, salt: str, by: str = "target") -> DataFrame:
    """Shuffled stratified k-fold: class sizes per fold differ by at most one. A fold is a stretch of its class's draws."""
    drawn = rows.withColumn("_d", hash_digits(F.col(key), salt))
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))  # one row per class
    ends = sizes.select(by, F.explode(F.transform(F.sequence(F.lit(1), F.lit(folds - 1)), lambda k: F.ceil(k * F.col("_size") / folds).cast("long"))).alias("n"))
    cuts = stratified_cuts(drawn, ends.distinct(), by)
    starts = ends.join(cuts.withColumnRenamed(by, "_by").withColumnRenamed("n", "_n"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("n") == F.col("_n")))
    per_class = F.broadcast(starts.groupBy(F.col(by).alias("_class")).agg(F.collect_list("cut").alias("_cuts")))
    fold = F.size(F.filter("_cuts", lambda c: c < F.col("_d")))
    return drawn.join(per_class, F.col(by).eqNullSafe(F.col("_class"))).select(*rows.columns, fold.cast("int").alias("fold"))


def stratified_sample(rows: DataFrame, key: str, n: int, salt: str, by: str = "target") -> DataFrame:
    """Exactly n rows; class quotas by largest remainder, rows by lowest seeded draw, found without sorting any."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))  # one row per class
    exact = F.lit(float(n)) * F.col("_size") / F.sum("_size").over(Window.partitionBy())
    quotas = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("long"))
    spare = F.lit(n) - F.sum("_floor").over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(by)))
    quotas = quotas.select(by, (F.col("_floor") + F.when(order <= spare, 1).otherwise(0)).cast("long").alias("n"))
    drawn = rows.withColumn("_d", hash_digits(F.col(key), salt))
    cuts = F.broadcast(stratified_cuts(drawn, quotas, by).select(F.col(by).alias("_class"), "cut"))
    return drawn.join(cuts, F.col(by).eqNullSafe(F.col("_class")) & (F.col("_d") <= F.col("cut"))).select(*rows.columns)


def class_weights(rows: DataFrame, target: str = "target") -> DataFrame:
    """Balanced weight n/(2*n_class) and the positive-class loss weight neg/pos, per class."""
    sizes = rows.groupBy(target).agg(F.count(F.lit(1)).alias("rows"))
    totals = rows.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(target) == 1).alias("_pos"))
    return attach(sizes, totals, []).select(
        target, "rows", (F.col("_n") / (F.lit(2.0) * F.col("rows"))).alias("balanced_weight"),
        F.when(F.col(target) == 1, (F.col("_n") - F.col("_pos")) / F.col("_pos")).otherwise(F.lit(1.0)).alias("loss_weight"))
