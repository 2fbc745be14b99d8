"""Fits in lockstep against fits alone, Spark's estimator and plain steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.operators import linear, models
from gradeline.operators.checks import ContractError


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(17)
    n = 900
    x1, x2 = rng.normal(size=n) * 3 + 100, rng.exponential(size=n)
    c = rng.choice(["a", "b", "c"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(0.5 - 0.4 * (x1 - 100) + 0.7 * (c == "b")))).astype(int)
    data = [(f"id{i}", None if i % 17 == 0 else float(a), float("nan") if i % 40 == 0 else float(b), None if i % 30 == 0 else str(k), int(t), i % 3)
            for i, (a, b, k, t) in enumerate(zip(x1, x2, c, y, strict=True))]
    rows = spark.createDataFrame(data, "loan_id string, x1 double, x2 double, c string, target int, block int")
    parts = spark.createDataFrame([(f, b, "holdout" if f == b else "fit") for f in range(3) for b in range(3)], "fold int, block int, part string")
    return rows.join(parts, "block").persist()


@pytest.mark.parametrize("balanced", [True, False])
def test_lockstep_equals_the_pipeline_of_each_fold(long, balanced):
    settings = models.LogisticSettings(balanced=balanced, tol=1e-12)
    clean = long.withColumn("x2", F.nanvl("x2", F.lit(None).cast("double")))
    whole = linear.Logistic(("x1", "x2"), ("c",), settings)
    part = linear.Logistic(("x1", "x2"), ("c",), settings, uses=("x1", "c"))
    scored = linear.out_of_fold(long, [0, 1, 2], [whole, part])
    for oof, numeric in zip(scored, (["x1", "x2"], ["x1"]), strict=True):
        got = {(r["fold"], r["loan_id"]): r["p"] for r in oof.collect()}
        assert len(got) == 900
        for fold in range(3):
            one = clean.filter(F.col("fold") == fold)
            alone = models.score(models.fit_logistic(one.filter("part = 'fit'"), numeric, ["c"], settings), one.filter("part = 'holdout'"))
            for r in alone.select("loan_id", "p").collect():
                assert got[fold, r["loan_id"]] == pytest.approx(r["p"], abs=1e-5)


def test_preparations_of_all_folds(long):
    pdf = long.filter("fold = 1 and part = 'fit'").toPandas()
    found = linear.preparations(long.filter("part = 'fit'"), ["x1", "x2"], ["c"])[1]
    for k, c in enumerate(("x1", "x2")):
        filled = pdf[c].fillna(pdf[c].median())
        assert (found.middle[k], found.mean[k], found.deviation[k]) == pytest.approx((pdf[c].median(), filled.mean(), filled.std(ddof=0)))
    assert found.levels == (("a", "b", "c", "missing"),)


def test_scores_of_unseen_levels_and_refusals(spark, long):
    model = linear.Logistic(("x1", "x2"), ("c",))(long.filter("fold = 0"))
    odd = spark.createDataFrame([(None, None, "never"), (float("nan"), 1.0, None)], "x1 double, x2 double, c string")
    assert all(0 < r["p"] < 1 for r in model.score(odd).collect()) and "(intercept)" in model.named()
    with pytest.raises(ContractError):
        linear.Logistic(("x1",))(long.filter("target = 1"))
    with pytest.raises(ContractError):
        linear.Logistic(("x1",))(long.withColumn("x1", F.lit(None).cast("double")))


def test_many_losses_are_minimised_at_once():
    rng = np.random.default_rng(1)
    problems = {k: (rng.normal(size=(40, 6)), rng.integers(0, 2, 40), 10.0 ** (k - 2)) for k in range(5)}

    def evaluate(points):
        out = {}
        for k, w in points.items():
            x, y, c = problems[k]
            z = x @ w
            out[k] = c * (np.logaddexp(0, z) - y * z).sum() + w @ w / 2, c * x.T @ (1 / (1 + np.exp(-z)) - y) + w
        return out

    found = linear.minimised(evaluate, {k: np.zeros(6) for k in problems}, 1e-9)
    for k, w in evaluate(found).items():
        assert np.abs(w[1]).max() < 1e-8
