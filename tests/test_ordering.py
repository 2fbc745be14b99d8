"""Running totals, ranks and quantiles agree with a plain sort, however the rows are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.operators import ordering, policy, scoring


@pytest.fixture(scope="module")
def scored(spark):
    """3,000 rows; one score holds a third of them, and one group holds most rows."""
    rng = np.random.default_rng(3)
    p = np.where(rng.random(3000) < 1 / 3, 0.5, np.round(rng.random(3000), 3))
    y = (rng.random(3000) < p).astype(int)
    group = np.where(rng.random(3000) < 0.8, "big", "small")
    rows = [(f"id{i:05d}", float(a), int(b), str(g)) for i, (a, b, g) in enumerate(zip(p, y, group))]
    return spark.createDataFrame(rows, "loan_id string, p double, target int, g string").repartition(5).persist(), p, y, group


def brute(p, y):
    order = np.unique(p)[::-1]
    pos = np.array([y[p == v].sum() for v in order], float)
    neg = np.array([(1 - y[p == v]).sum() for v in order], float)
    tp, fp = pos.cumsum(), neg.cumsum()
    return ((tp - pos / 2) * neg).sum() / (pos.sum() * neg.sum()), (pos / pos.sum() * tp / (tp + fp)).sum()


@pytest.mark.parametrize("rows_per_range", [50, 400, 10**6])
def test_metrics_do_not_depend_on_the_ranges(scored, rows_per_range):
    df, p, y, group = scored
    bounds = ordering.range_bounds(df, "p", rows_per_range)
    assert bool(bounds) == (rows_per_range < 3000)
    got = {r["g"]: r for r in scoring.evaluate(df, by=["g"], bounds=bounds).collect()}
    for name in ("big", "small"):
        auc, ap = brute(p[group == name], y[group == name])
        assert got[name]["roc_auc"] == pytest.approx(auc, abs=1e-12)
        assert got[name]["pr_auc"] == pytest.approx(ap, abs=1e-12)


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_global_rank_is_the_plain_sort(scored, partitions):
    df, p, y, _ = scored
    got = ordering.global_rank(df, ["p", "loan_id"], {"events": "target"}, partitions).orderBy("rank").collect()
    order = np.lexsort((np.arange(len(p)), p))
    assert [r["rank"] for r in got] == list(range(1, len(p) + 1))
    assert [r["loan_id"] for r in got] == [f"id{i:05d}" for i in order]
    assert [r["events"] for r in got] == list(y[order].cumsum())


def test_rate_at_approval_settles_ties_by_id(scored):
    df, p, y, _ = scored
    order = np.lexsort((np.arange(len(p)), p))
    for row in policy.rate_at_approval(df, [0.1, 0.5, 0.9]).collect():
        k = max(round(row["approval_rate"] * len(p)), 1)
        assert (row["approved"], row["events_among_approved"]) == (k, y[order][:k].sum())


@pytest.mark.parametrize("bounds", [[], [0.2, 0.5, 0.5, 0.9]])
def test_exact_quantiles_are_numpys(scored, bounds):
    df, p, _, group = scored
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in ordering.exact_quantiles(df, "p", probs, ["g"], bounds).collect()}
    for name in ("big", "small"):
        for prob in probs:
            assert got[name, prob] == pytest.approx(np.quantile(p[group == name], prob), abs=1e-12)


def test_threshold_below_every_score_has_no_rate(scored):
    df, p, _, _ = scored
    first = policy.policy_table(df, [0.0, 0.5, 1.0]).orderBy("threshold").collect()
    assert first[0]["approved"] == 0 and first[0]["event_rate_among_approved"] is None
    assert first[1]["approved"] == (p < 0.5).sum()  # strictly below


def test_one_class_group_has_no_ranking_metric(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "p double, target int")
    row = scoring.evaluate(df).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["brier_score"] is not None


def test_best_f1_takes_the_lowest_of_equal_thresholds(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 0), (0.6, 1)], "p double, target int")
    best = scoring.best_f1(scoring.ranked_groups(df)).first()
    assert (best["f1_best"], best["f1_best_threshold"]) == (pytest.approx(2 / 3), 0.6)


def test_unreachable_recall_gives_no_row(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0)], "p double, target int")
    assert scoring.threshold_for_recall(df, [0.5, 1.5]).filter(F.col("target_recall") == 1.5).count() == 0


def test_null_group_keeps_its_rows(spark):
    from gradeline.operators import ordering

    rows = spark.createDataFrame([(g, float(k), 1) for g in ("a", None) for k in range(6)], "g string, x double, n long")
    for bounds in ([], [1.5, 3.5]):
        got = ordering.running_totals(rows, "x", {"cum": "n"}, ["g"], bounds).collect()
        assert sorted((r.g or "", r.x, r.cum) for r in got) == sorted((g, float(k), k + 1) for g in ("a", "") for k in range(6))
        medians = ordering.exact_quantiles(rows, "x", [0.5], ["g"], bounds).collect()
        assert sorted((r.g or "", r.quantile) for r in medians) == [("", 2.5), ("a", 2.5)]
    ranks = ordering.global_rank(rows, ["x"], {"cum": "n"}, by=["g"]).collect()
    assert sorted((r.g or "", r["rank"]) for r in ranks) == sorted((g, k + 1) for g in ("a", "") for k in range(6))


@pytest.mark.parametrize("near", [0.002, 0.2])
def test_bracketed_medians_equal_plain_ones(spark, near):
    import random
    import statistics

    rng = random.Random(9)
    data = [(k % 3, None if k % 11 == 0 else round(rng.gauss(0, 5), 1), float(k % 2), None if k % 3 == 1 else rng.random()) for k in range(2000)]
    data += [(7, 1.5, 2.0, None), (7, -4.0, 2.0, None)]
    rows = spark.createDataFrame(data, "fold int, a double, b double, c double")
    want = {}
    for at, name in ((1, "a"), (2, "b"), (3, "c")):
        for fold in (0, 1, 2, 7):
            if values := [r[at] for r in data if r[0] == fold and r[at] is not None]:
                want[fold, name] = pytest.approx(statistics.median(values))
    assert ordering.exact_medians(rows, ["a", "b", "c"], "fold", near) == want
