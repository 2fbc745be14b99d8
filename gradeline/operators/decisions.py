"""Predeclared decision rules over bounded delta tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.operators.scoring import HIGHER_IS_BETTER

PROBABILITY_METRICS = ("brier_score", "log_loss")


def _lookup(values: Mapping[str, object]) -> Column:
    out = F.lit(None)
    for metric, value in values.items():
        out = F.when(F.col("metric") == metric, F.lit(value)).otherwise(out)
    return out


def verdicts(deltas: DataFrame, margins: Mapping[str, float]) -> DataFrame:
    """Adds clearly_better, verdict and improves to (…, metric, delta, ci_low, ci_high) rows.

    Better means beyond the margin with an interval on the better side of zero; worse is the mirror.
    """
    higher, margin = _lookup({m: HIGHER_IS_BETTER[m] for m in margins}), _lookup(margins)
    gain = F.when(higher, F.col("delta")).otherwise(-F.col("delta"))
    low = F.when(higher, F.col("ci_low")).otherwise(-F.col("ci_high"))
    high = F.when(higher, F.col("ci_high")).otherwise(-F.col("ci_low"))
    better, worse = (gain > margin) & (low > 0), (-gain > margin) & (high < 0)
    return deltas.select(
        "*", better.alias("clearly_better"),
        F.when(better, "better").when(worse, "worse").otherwise("no clear difference").alias("verdict"), (low > 0).alias("improves"))


def verdict_summary(table: DataFrame, by: Sequence[str] = ("candidate", "baseline")) -> DataFrame:
    """'clearly better', 'clearly worse', 'no clear difference' or 'mixed' per pair."""
    seen = F.collect_set("verdict")  # at most three values
    return table.groupBy(*by).agg(seen.alias("_v")).select(*by, (
        F.when(F.size("_v") > 1, "mixed").when(F.element_at("_v", 1) == "better", "clearly better")
        .when(F.element_at("_v", 1) == "worse", "clearly worse").otherwise(F.element_at("_v", 1))).alias("summary"))


def champion(table: DataFrame, incumbent: str, challenger: str, margins: Mapping[str, float]) -> DataFrame:
    """The challenger wins when clearly better on a probability metric and within the margin on AUC."""
    pair = table.filter((F.col("candidate") == challenger) & (F.col("baseline") == incumbent))
    quality = F.bool_or(F.col("metric").isin(*PROBABILITY_METRICS) & F.col("clearly_better"))
    ranking = F.bool_or((F.col("metric") == "roc_auc") & (F.col("delta") >= -margins["roc_auc"]))
    return pair.agg(quality.alias("_q"), ranking.alias("_r")).select(
        F.lit(incumbent).alias("incumbent"), F.lit(challenger).alias("challenger"),
        F.col("_q").alias("challenger_clearly_better_on_probability_quality"), F.col("_r").alias("challenger_not_worse_on_roc_auc"),
        (F.col("_q") & F.col("_r")).alias("challenger_wins"), F.when(F.col("_q") & F.col("_r"), challenger).otherwise(incumbent).alias("recommendation"))


STEP_FIELDS = ("baseline", "candidate", "metric", "delta", "ci_low", "ci_high", "clearly_better")


def choose_method(comparisons: Sequence[Mapping[str, object]], methods: Sequence[str], metric: str) -> tuple[str, list[dict]]:
    """The method left after each challenger in turn met the holder, and the verdict rows of these meetings.

    The holder loses to a challenger that is clearly better; ``comparisons`` are a few collected rows.
    """
    verdicts = {(r["baseline"], r["candidate"]): r for r in comparisons if r["metric"] == metric}
    holders = list(accumulate(methods[1:], lambda holder, rival: rival if verdicts[holder, rival]["clearly_better"] else holder,
                              initial=methods[0]))
    met = (verdicts[pair] for pair in zip(holders, methods[1:]))
    return holders[-1], [{field: verdict[field] for field in STEP_FIELDS} for verdict in met]
