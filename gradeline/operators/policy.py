"""Approval policy curves: approve a row when its score is strictly below the threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.functions.columns import ratio
from gradeline.operators.ordering import attach, global_rank, range_bounds, running_totals
from gradeline.operators.scoring import at_thresholds, score_groups


def policy_table(df: DataFrame, thresholds: Sequence[float], p: str = "p", y: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Approvals, events among them and both rates per threshold; the rate is NULL when nothing is approved."""
    base = at_thresholds(df, thresholds, p, y, by)
    return base.select(
        *by, "threshold", F.col("rows_below").alias("approved"),
        ratio(F.col("rows_below"), F.col("rows")).alias("approval_rate"),
        F.col("events_below").alias("events_among_approved"),
        ratio(F.col("events_below"), F.col("rows_below")).alias("event_rate_among_approved"))


def approval_curve(df: DataFrame, p: str = "p", y: str = "target", key: str = "loan_id") -> DataFrame:
    """Event rate among the k lowest-risk rows for every k; equal scores are ordered by key."""
    rows = df.select(key, F.col(p).alias("_p"), F.col(y).cast("long").alias("_y"))
    ranked = global_rank(rows, ["_p", key], {"_events": "_y"})
    return attach(ranked, rows.agg(F.count(F.lit(1)).alias("_n")), []).select(
        F.col("rank").alias("approved"), ratio(F.col("rank"), F.col("_n")).alias("approval_rate"),
        ratio(F.col("_events"), F.col("rank")).alias("event_rate_among_approved"))


def rate_at_approval(df: DataFrame, rates: Sequence[float], p: str = "p", y: str = "target", key: str = "loan_id") -> DataFrame:
    """Event rate among the k = max(round(rate * n), 1) lowest-risk rows, half to even.

    Score groups settle everything except the group that holds the k-th row. Only those tied
    rows (at most one group per rate) are ranked by key.
    """
    groups = score_groups(df, p, y).withColumn("n", F.col("pos") + F.col("neg"))
    ranked = running_totals(groups, "p", {"cum_n": "n", "cum_pos": "pos"}, (), range_bounds(df, p))
    totals = groups.agg(F.sum("n").alias("_rows"))
    asked = F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("approval_rate")
    k = F.greatest(F.bround(F.col("approval_rate") * F.col("_rows"), 0).cast("long"), F.lit(1))
    edge = (
        attach(ranked, totals, []).select("*", asked).withColumn("k", k)
        .filter((F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k")))
        .select("approval_rate", "k", F.col("p").alias("_edge"), (F.col("k") - (F.col("cum_n") - F.col("n"))).alias("_take"),
                (F.col("cum_pos") - F.col("pos")).alias("_before"))
    )
    tied = df.join(F.broadcast(edge.select(F.col("_edge").alias(p)).distinct()), p, "left_semi").select(
        F.col(p).alias("_edge"), key, F.col(y).cast("long").alias("_y"))
    within = global_rank(tied, [key], {"_events": "_y"}, by=["_edge"])
    return (
        edge.join(within.select("_edge", F.col("rank").alias("_take"), "_events"), ["_edge", "_take"])
        .select("approval_rate", F.col("k").alias("approved"), (F.col("_before") + F.col("_events")).alias("events_among_approved"),
                ratio(F.col("_before") + F.col("_events"), F.col("k")).alias("event_rate_among_approved"))
    )
