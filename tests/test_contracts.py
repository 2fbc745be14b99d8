"""Each contract violation is counted, and enforce names it."""

import pytest
from pyspark.sql import functions as F

from gradeline.operators import checks, fusion, joins, roles
from gradeline.plans import cohort, features


def counts(df):
    return {r["check"]: r["violations"] for r in df.collect()}


@pytest.fixture(scope="module")
def expected(spark):
    return spark.createDataFrame([(f"lc_{i:09d}",) for i in range(1, 5)], "loan_id string")


def predictions(spark, rows):
    return spark.createDataFrame(rows, "loan_id string, split string, p_default_tabular double, model_name string, model_version string")


def test_prediction_contract(spark, expected):
    good = [(f"lc_{i:09d}", "validation", 0.1 * i, "m", "v") for i in range(1, 5)]
    checks.enforce(checks.prediction_checks(predictions(spark, good), expected))
    bad = [good[0], good[0], good[1], ("lc_000000099", "validation", 1.2, "m", "v"), (good[2][0], "validation", None, "m", "v")]
    got = counts(checks.prediction_checks(predictions(spark, bad), expected))
    assert got == {"missing": 1, "extra": 1, "duplicates": 1, "null_probability": 1, "outside_unit_interval": 1}
    with pytest.raises(checks.ContractError, match="missing"):
        checks.enforce(checks.prediction_checks(predictions(spark, bad), expected))
    with pytest.raises(checks.ContractError, match="columns"):
        checks.prediction_checks(predictions(spark, good).drop("split"), expected)


def test_export_contract(spark):
    mapping = spark.createDataFrame([("a", "train", "fusion_fit"), ("b", "validation", "validation")], "loan_id string, split string, role string")
    export = mapping.select("*", F.lit(0.0).alias("raw_margin"), F.lit(0.5).alias("raw_prob"), F.lit("v1").alias("model_version"))
    checks.enforce(checks.export_checks(export, mapping, "v1"))
    off = export.withColumn("raw_prob", F.when(F.col("loan_id") == "a", 0.51).otherwise(0.5)).withColumn("role", F.lit("validation"))
    got = counts(checks.export_checks(off, mapping, "v1"))
    assert got["not_sigmoid_of_margin"] == 1 and got["role_disagrees"] == 1 and got["missing"] == 0


def test_join_refuses_missing_and_repeated_keys(spark, expected):
    scores = expected.withColumn("s", F.lit(1.0))
    assert joins.checked_join(expected, scores).count() == 4
    with pytest.raises(checks.ContractError, match="unmatched_base_rows"):
        joins.checked_join(expected, scores.filter("loan_id <> 'lc_000000002'"))
    with pytest.raises(checks.ContractError, match="repeated_other_keys"):
        joins.checked_join(expected, scores.unionByName(scores.limit(1)))
    with pytest.raises(checks.ContractError, match="unused_other_rows"):
        joins.checked_join(expected.filter("loan_id <> 'lc_000000002'"), scores, exact=True)


def test_cohort_rule(spark):
    rows = [("Jan-1995", "Fully Paid", "a"), ("Dec-2001", "Charged Off", "n/a"), ("Jan-2000", "Fully Paid", " \t "), ("Jan-2000", "Current", "x"),
            ("Jan-2002", "Fully Paid", "x"), ("bad", "Fully Paid", "x"), ("Feb-2000", "Fully Paid", None)]
    raw = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "source_row_number long, issue_d string, loan_status string, desc string")
    got = cohort.registry(raw, cohort.SETTINGS).orderBy("loan_id").collect()
    assert [(r["loan_id"], r["split"], r["target"]) for r in got] == [("lc_000000001", "train", 0), ("lc_000000002", "test", 1)]
    assert tuple(cohort.diagnostics(raw, cohort.SETTINGS).first()) == (7, 2, 1)


def test_locked_split_is_refused_before_any_read(spark):
    with pytest.raises(ValueError, match="locked"):
        cohort.split_targets(None, "test")
    with pytest.raises(ValueError, match="unknown"):
        cohort.split_targets(None, "holdout")


def test_leaking_feature_lists_are_refused():
    from dataclasses import replace

    features.validate(features.DEFAULT)
    for change in ({"numeric": (*features.DEFAULT.numeric, "int_rate")}, {"source": (*features.DEFAULT.source, "total_pymnt")},
                   {"numeric": (*features.DEFAULT.numeric, "target")}, {"numeric": (*features.DEFAULT.numeric, "dti")},
                   {"derived": {"x": {"transform": "log1p", "from": ["nowhere"]}}}):
        with pytest.raises(checks.ContractError):
            features.validate(replace(features.DEFAULT, **change))
    with pytest.raises(checks.ContractError):
        features.feature_sets(features.DEFAULT, {"one": ["dti"]})


def test_month_ranges(spark):
    good = roles.range_table(spark, [("a", "train", "2012-01", "2012-06"), ("b", "train", "2012-07", "2012-09"), ("c", "validation", "2012-10", "2012-12")])
    assert set(counts(roles.range_checks(good)).values()) == {0}
    bad = roles.range_table(spark, [("a", "train", "2012-01", "2012-06"), ("b", "train", "2012-06", "2012-05"), ("c", "train", "2012-09", "2012-13")])
    assert counts(roles.range_checks(bad)) == {"bad_month": 1, "reversed_range": 1, "overlap": 1, "gap": 1}


def test_too_few_months_fail_the_fold_check(spark):
    rows = spark.createDataFrame([(f"id{i}", f"2012-0{1 + i % 2}") for i in range(30)], "loan_id string, issue_month string")
    got = counts(roles.fold_checks(roles.expanding_folds(rows, 5, 0.4), 5))
    assert got["empty_folds"] == 4 and got["fit_and_holdout"] == 0


ARTIFACT = {"stacker_version": "s", "variant": "v", "tracks": ["tabular", "text"], "coefficients": [1.0, 2.0], "intercept": -1.0,
            "calibrator": {"slope": 1.0, "intercept": 0.0, "probability_clip": 1e-6},
            "fallback": {"slope": 1.0, "intercept": 0.5, "probability_clip": 1e-6, "version": "f"}}


def test_fallback_and_refusals(spark):
    rows = spark.createDataFrame(
        [("ok", 0.2, 0.4, True), ("fallback", 0.2, None, False), ("no_text_score", 0.2, None, True), ("no_tabular", None, 0.4, True),
         ("both", 0.2, 0.4, False), ("range", 0.2, 1.4, True), ("nan", float("nan"), 0.4, True), ("flag", 0.2, 0.4, None)],
        "loan_id string, p_default_tabular double, p_default_text double, text_usable boolean")
    got = {r["loan_id"]: r for r in fusion.predict(rows, ARTIFACT).collect()}
    sigmoid = lambda m: 1 / (1 + 2.718281828459045 ** -m)
    assert got["ok"]["p_default"] == pytest.approx(sigmoid(0.2 + 0.8 - 1)) and got["ok"]["source"] == "fusion_stacker"
    assert got["fallback"]["p_default"] == pytest.approx(sigmoid(-1.3862943611198906 + 0.5)) and got["fallback"]["fallback"]
    reasons = {k: v["reject_reason"] for k, v in got.items()}
    assert reasons == {"ok": None, "fallback": None, "no_text_score": "missing_score", "no_tabular": "missing_score", "both": "text_score_without_text",
                       "range": "bad_score", "nan": "bad_score", "flag": "text_flag_missing"}
    assert all(v["p_default"] is None for k, v in got.items() if reasons[k])


def test_shared_ids_are_counted_per_pair(spark):
    sets = {n: spark.createDataFrame([(i,) for i in ids], "id int") for n, ids in {"a": [1, 2, 3], "b": [3, 4], "c": [9]}.items()}
    got = {(r["left_set"], r["right_set"]): r["shared"] for r in checks.disjointness(sets, "id").collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 0, ("b", "c"): 0}
