"""Exact, tie-aware metrics. Every metric reads one score-group table (by..., p, pos, neg)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.columns import LOG_LOSS_EPS, clip, ratio
from gradeline.operators.ordering import attach, exact_quantiles, range_bounds, running_totals, with_range

METRICS = ("roc_auc", "pr_auc", "brier_score", "log_loss")
HIGHER_IS_BETTER = {"roc_auc": True, "pr_auc": True, "brier_score": False, "log_loss": False}


def present(p: Column | str) -> Column:
    """The score as a double; a NULL or NaN one ends the job, whatever the size and path of the aggregate that reads it."""
    value = (F.col(p) if isinstance(p, str) else p).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit("scores must be present numbers"))).otherwise(value)


def score_groups(df: DataFrame, p: str = "p", y: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Counts per distinct score; ties and hot scores collapse on the map side."""
    return df.groupBy(*by, present(p).alias("p")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))


def ranked_groups(
    df: DataFrame, p: str = "p", y: str = "target", by: Sequence[str] = (), bounds: Sequence[float] | None = None
) -> DataFrame:
    """Score groups with true and false positives at ``score >= p`` (tp, fp)."""
    if bounds is None:
        bounds = range_bounds(df, p)
    groups = score_groups(df, p, y, by)
    return running_totals(groups, "p", {"tp": "pos", "fp": "neg"}, by, bounds, descending=True)


def class_totals(df: DataFrame, y: str = "target", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.sum(F.col(y).cast("long")).alias("positives"), F.sum((1 - F.col(y)).cast("long")).alias("negatives"))


def metric_table(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, mean score, AUC, average precision, Brier score and log loss per group.

    A one-class group has no AUC: the ranking metrics are NULL there and a check reports it.
    """
    q = clip(F.col("p"), LOG_LOSS_EPS)
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("rows"),
        F.sum("pos").alias("positives"),
        F.sum(F.col("p") * (F.col("pos") + F.col("neg"))).alias("_p"),
        F.sum((F.col("tp") - F.col("pos") / F.lit(2.0)) * F.col("neg")).alias("_auc"),
        F.sum(F.when(F.col("tp") + F.col("fp") > 0,
                     F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).otherwise(0.0)).alias("_ap"),
        F.sum(F.col("pos") * F.pow(1 - F.col("p"), F.lit(2)) + F.col("neg") * F.pow(F.col("p"), F.lit(2))).alias("_brier"),
        F.sum(-F.col("pos") * F.ln(q) - F.col("neg") * F.ln(1 - q)).alias("_loss"),
    )
    negatives = F.col("rows") - F.col("positives")
    both = (F.col("positives") > 0) & (negatives > 0)
    return sums.select(
        *by, "rows", "positives", (F.col("positives") / F.col("rows")).alias("prevalence"),
        (F.col("_p") / F.col("rows")).alias("mean_p"),
        (F.col("_p") / F.col("rows") - F.col("positives") / F.col("rows")).alias("mean_p_minus_prevalence"),
        F.when(both, ratio(F.col("_auc"), F.col("positives").cast("double") * negatives)).alias("roc_auc"),
        F.when(both, ratio(F.col("_ap"), F.col("positives"))).alias("pr_auc"),
        (F.col("_brier") / F.col("rows")).alias("brier_score"), (F.col("_loss") / F.col("rows")).alias("log_loss"),
    )


def evaluate(df: DataFrame, p: str = "p", y: str = "target", by: Sequence[str] = (),
             bounds: Sequence[float] | None = None) -> DataFrame:
    """The metric row of every group in one job."""
    return metric_table(ranked_groups(df, p, y, by, bounds), by)


def to_versions(df: DataFrame, versions: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide score columns to long rows (keep..., version, p)."""
    return df.unpivot(list(keep), list(versions), "version", "p")


def best_f1(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best F1 over the observed thresholds and the lowest threshold that reaches it."""
    totals = ranked.groupBy(*by).agg(F.sum("pos").alias("positives"))
    f1 = F.lit(2.0) * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("p")).alias("minus_p")))
    return attach(ranked, totals, by).groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.f1").alias("f1_best"), (-F.col("_b.minus_p")).alias("f1_best_threshold"))


def confusion(p: Column, y: Column, threshold: float | Column) -> list[Column]:
    """Aggregates tn, fp, fn, tp at ``p >= threshold``."""
    p = present(p)
    flagged = p >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    return [
        F.count_if(~flagged & (y == 0)).alias("tn"), F.count_if(flagged & (y == 0)).alias("fp"),
        F.count_if(~flagged & (y == 1)).alias("fn"), F.count_if(flagged & (y == 1)).alias("tp"),
    ]


def f1_at(p: Column, y: Column, threshold: float) -> Column:
    p = present(p)
    tp = F.count_if((p >= threshold) & (y == 1))
    return ratio(2 * tp, F.count_if(p >= threshold) + F.count_if(y == 1), 0.0)


def curve_points(df: DataFrame, p: str = "p", y: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    ranked = ranked_groups(df, p, y, by)
    totals = ranked.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return attach(ranked, totals, by).select(
        *by, F.col("p").alias("threshold"), ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
        ratio(F.col("tp"), F.col("positives")).alias("tpr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def counts_between(df: DataFrame, thresholds: Sequence[float], p: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rows and events per gap between thresholds: (by..., gap, n, events), gap = thresholds <= p."""
    return with_range(df.select(*by, present(p).alias(p), y), p, thresholds, "gap").groupBy(*by, "gap").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("events"))


def at_thresholds(df: DataFrame, thresholds: Sequence[float], p: str = "p", y: str = "target",
                  by: Sequence[str] = ()) -> DataFrame:
    """Per threshold: rows and events below it, and the group's totals.

    Rows collapse to at most one row per gap before any threshold is looked at.
    """
    grid = sorted(set(float(t) for t in thresholds))
    gaps = counts_between(df, grid, p, y, by)
    asked = F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("_j", "threshold")
    below = F.col("gap") <= F.col("_j")
    return gaps.select("*", asked).groupBy(*by, "threshold").agg(
        F.sum(F.when(below, F.col("n")).otherwise(0)).alias("rows_below"),
        F.sum(F.when(below, F.col("events")).otherwise(0)).alias("events_below"),
        F.sum("n").alias("rows"), F.sum("events").alias("events"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], p: str = "p", y: str = "target",
                    by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates at every named threshold."""
    base = at_thresholds(df, thresholds, p, y, by)
    tp, fn = F.col("events") - F.col("events_below"), F.col("events_below")
    fp = (F.col("rows") - F.col("rows_below")) - tp
    counts = base.select(*by, "threshold", (F.col("rows_below") - fn).alias("tn"), fp.alias("fp"), fn.alias("fn"),
                         tp.alias("tp"), "rows")
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)
    return counts.select(
        *by, "threshold", "tn", "fp", "fn", "tp", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.lit(2.0) * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)).alias("f1"),
        ratio(F.col("fp"), F.col("tp"), float("inf")).alias("false_positives_per_true_positive"),
        ratio(F.col("tp") + F.col("fp"), F.col("rows")).alias("flagged_rate"))


def threshold_for_recall(df: DataFrame, targets: Sequence[float], p: str = "p", y: str = "target") -> DataFrame:
    """Highest observed threshold whose recall reaches each target, with its confusion counts."""
    ranked = ranked_groups(df, p, y)
    totals = ranked.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    reach = attach(ranked, totals, []).select(
        "*", F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_recall")
    ).filter(F.col("tp") / F.col("positives") >= F.col("target_recall"))
    pick = reach.groupBy("target_recall").agg(
        F.max(F.struct("p", "tp", "fp", "positives", "negatives")).alias("_b")).select("target_recall", "_b.*")
    return pick.select(
        "target_recall", F.col("p").alias("threshold"), ratio(F.col("tp"), F.col("positives")).alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0).alias("precision"), "tp", "fp",
        (F.col("positives") - F.col("tp")).alias("fn"), (F.col("negatives") - F.col("fp")).alias("tn"),
        ratio(F.col("fp"), F.col("tp"), float("inf")).alias("false_positives_per_true_positive"),
        ratio(F.col("tp") + F.col("fp"), F.col("positives") + F.col("negatives")).alias("flagged_rate"))


def reliability(df: DataFrame, bins: int = 10, strategy: str = "quantile", p: str = "p", y: str = "target") -> DataFrame:
    """Mean score against observed rate per bin; a bin holds scores above its left inner edge."""
    if strategy == "quantile":
        rows = exact_quantiles(df, p, [i / bins for i in range(1, bins)]).collect()  # bins - 1 rows
        edges = sorted(row["quantile"] for row in rows)
    else:
        edges = [i / bins for i in range(1, bins)]
    inner = F.array(*[F.lit(e) for e in edges])
    bin_number = F.size(F.filter(inner, lambda e: e < F.col("p")))
    groups = score_groups(df, p, y)
    return groups.groupBy(bin_number.alias("bin")).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("rows"),
        (F.sum(F.col("p") * (F.col("pos") + F.col("neg"))) / F.sum(F.col("pos") + F.col("neg"))).alias("mean_predicted"),
        (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("observed_rate"))


def histogram(df: DataFrame, bins: int, p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Fixed-width bins over [0, 1]; the last bin holds 1.0."""
    bin_number = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(*by, bin_number.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Share of rows at or below each distinct value."""
    counts = df.groupBy(F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    bounds = range_bounds(df.select(F.col(value).cast("double").alias("value")), "value")
    ranked = running_totals(counts, "value", {"cum": "rows"}, (), bounds)
    return attach(ranked, counts.agg(F.sum("rows").alias("_n")), []).select(
        "value", "rows", "cum", (F.col("cum") / F.col("_n")).alias("share"))


def interval_verdict(point: Column, low: Column, target: float) -> Column:
    """PASS when the whole interval clears the target, INCONCLUSIVE when only the point does."""
    return F.when(low > target, "PASS").when(point > target, "INCONCLUSIVE").otherwise("FAIL")
