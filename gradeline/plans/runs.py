"""Composed runs: each returns DataFrames built from the operators; nothing here adds a new primitive."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.functions.columns import differs, is_probability
from gradeline.operators import calibration, checks, decisions, fusion, joins, linear, models, roles, scoring
from gradeline.operators.resample import paired_deltas


def logistic_baseline(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Fit on train, check the prediction table of both splits, grade them."""
    model = linear.Logistic(tuple(numeric), tuple(categorical))(rows.filter("split = 'train'"))
    scored = models.score(model, rows).select("loan_id", "split", "target", "p").persist()
    table = fusion.prediction_table(scored, F.col("p"), "logistic_regression", "tabular-logistic-v1")
    checks.enforce(checks.prediction_checks(table, rows), "predictions")
    return scoring.evaluate(scored, by=["split"])


def out_of_fold_export(long: DataFrame, folds: Sequence[int], fit: models.Fitter, version: str) -> DataFrame:
    """Checked folds, one out-of-fold score per held-out row with its fold id."""
    checks.enforce(roles.fold_checks(long, len(folds)), "folds")
    oof = models.cross_validate(long, folds, fit).persist()
    held = long.filter("part = 'holdout'").select("loan_id", "fold")
    checks.enforce(checks.coverage_checks(oof, held, ["loan_id", "fold"]), "out-of-fold coverage")
    checks.enforce(checks.row_checks(oof, {"invalid_probability": ~is_probability(F.col("p"))}), "out-of-fold scores")
    return oof.select("loan_id", F.lit("train").alias("split"), F.col("p").alias("p_default_tabular"), F.col("fold").alias("fold_id"),
                      F.lit("logistic_regression").alias("model_name"), F.lit(version).alias("model_version"))


def candidate_predictions(rows: DataFrame, candidates: Mapping[str, models.Fitter], sets: Mapping[str, Sequence[str]], fit_role: str = "base_fit") -> DataFrame:
    """Score every set with every candidate after disjointness checks; one summary row per candidate and set."""
    fit = rows.filter(F.col("role") == fit_role)
    members = {"fit": fit, **{name: rows.filter(F.col("role").isin(*names)) for name, names in sets.items()}}
    shared = checks.disjointness(members, "loan_id").withColumn("passed", F.col("shared") == 0)
    checks.enforce(shared, "scoring sets")
    label = reduce(lambda out, item: out.when(F.col("role").isin(*item[1]), item[0]), sets.items(), F)
    scoring_rows = rows.filter(F.col("role") != fit_role).withColumn("set", label).filter("set is not null")
    parts = [models.score(fitter(fit), scoring_rows).select(F.lit(name).alias("candidate"), "set", "loan_id", "target", "p") for name, fitter in candidates.items()]
    scored = reduce(DataFrame.unionByName, parts).persist()
    expected = scoring_rows.groupBy("set").agg(F.count(F.lit(1)).alias("expected_rows"))
    ranges = scored.groupBy("candidate", "set").agg(F.min("p").alias("min_p"), F.max("p").alias("max_p"))
    return scoring.evaluate(scored, by=["candidate", "set"]).join(ranges, ["candidate", "set"]).join(F.broadcast(expected), "set").select(
        "candidate", "set", "rows", "expected_rows", "min_p", "max_p", *scoring.METRICS)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares through spark.checkpoint.dir; a local one only where none is named and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured or tempfile.mkdtemp(prefix="gradeline-out-")


def reload_equality(fit_rows: DataFrame, rows: DataFrame, fit: models.Fitter, path: str | None = None) -> DataFrame:
    """Save a fitted model, load it, and count the scores that differ at all."""
    import uuid

    model = fit(fit_rows)
    path = path or f"{shared_folder(rows.sparkSession)}/model-{uuid.uuid4().hex}"
    again = models.save_model(model, path)
    return models.score_differences(models.score(model, rows), models.score(again, rows))


def text_baseline(docs: DataFrame, counts: DataFrame, settings: models.TextSettings) -> DataFrame:
    """Vocabulary, idf and coefficients from the fit role; metrics of every role."""
    docs = docs.select("loan_id", "role", "target")
    fitted = models.fit_text(docs.filter("role = 'base_fit'"), counts, settings)
    return scoring.evaluate(models.score_text(fitted, docs, counts, settings), by=["role"])


def text_export(docs: DataFrame, counts: DataFrame, settings: models.TextSettings, version: str) -> DataFrame:
    """The six-column export of the scoring roles; a failed contract raises before anything is returned."""
    fitted = models.fit_text(docs.filter("role = 'base_fit'").select("loan_id", "target"), counts, settings)
    rows = docs.filter("role <> 'base_fit'").select("loan_id", "split", "role")
    export = models.score_text(fitted, rows, counts, settings).select(
        "loan_id", "split", "role", F.col("margin").alias("raw_margin"), F.col("p").alias("raw_prob"), F.lit(version).alias("model_version")).persist()
    checks.enforce(checks.export_checks(export, rows, version), "text export")
    return export


def reproduced(now: DataFrame, recorded: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Metric rows beside the recorded ones; a row on one side only is not reproduced."""
    return now.join(recorded, list(keys), "full_outer").withColumn(
        "reproduced", ~differs(F.col("value"), F.col("recorded"), tolerance))


def reference_scores(reference: DataFrame, graded: DataFrame, version: str) -> DataFrame:
    """Reference scores for exactly the graded ids, one version, finite and in [0, 1]."""
    checks.enforce(checks.coverage_checks(reference, graded, ["loan_id"]), "reference ids")
    checks.enforce(checks.row_checks(reference, {
        "invalid_reference": ~is_probability(F.col("p_reference")), "wrong_version": F.col("model_version") != version}), "reference scores")
    return joins.checked_join(graded.select("loan_id"), reference.drop("model_version"), exact=True, name="reference")


def calibration_decision(rows: DataFrame, incumbent: str, challenger: str, margins: Mapping[str, float], metric: str = "log_loss",
                         replicates: int = 1000, methods: Sequence[str] = ("raw", "platt", "isotonic")) -> DataFrame:
    """Method choice per candidate on validation, then the champion rule between the chosen versions."""
    long, _ = calibration.calibrate_all(rows, [incumbent, challenger], "calibration", methods)
    graded = long.filter(F.col("set") == "validation").withColumn("version", F.concat_ws("_", "candidate", "method"))
    versions = [f"{c}_{m}" for c in (incumbent, challenger) for m in methods]
    wide = graded.groupBy("loan_id", "target").pivot("version", versions).agg(F.first("p")).persist()
    pairs = [(f"{c}_{b}", f"{c}_{a}") for c in (incumbent, challenger) for i, a in enumerate(methods) for b in methods[i + 1:]]
    table = decisions.verdicts(paired_deltas(wide, pairs, replicates, metrics=(metric,)), margins).collect()  # a few rows per pair
    chosen, steps = {}, []
    for candidate in (incumbent, challenger):
        chosen[candidate], taken = decisions.choose_method(table, [f"{candidate}_{m}" for m in methods], metric)
        steps += [("method", s["baseline"], s["candidate"], str(s["clearly_better"]).lower(), chosen[candidate]) for s in taken]
    final = decisions.verdicts(paired_deltas(wide, [(chosen[challenger], chosen[incumbent])], replicates), margins)
    winner = decisions.champion(final, chosen[incumbent], chosen[challenger], margins).first()
    steps.append(("champion", chosen[incumbent], chosen[challenger], str(winner["challenger_wins"]).lower(), winner["recommendation"]))
    return rows.sparkSession.createDataFrame(steps, "step string, baseline string, candidate string, clearly_better string, chosen string")


STACKER = models.LogisticSettings(C=1.0, balanced=False, tol=1e-10)


def fit_stacker(rows: DataFrame, tracks: Sequence[str]) -> tuple[list[float], float]:
    """Unweighted L2 logistic regression on the raw track probabilities: coefficients and intercept."""
    from pyspark.ml.feature import VectorAssembler

    weighted, total = models.with_class_weight(rows, balanced=False)
    vectors = VectorAssembler(inputCols=[fusion.score_column(t) for t in tracks], outputCol="features").transform(weighted)
    model = models.linear_classifier(STACKER, total).fit(models.few_tasks(vectors, total))
    return model.coefficients.toArray().tolist(), float(model.intercept)


def stacking(rows: DataFrame, variants: Mapping[str, Sequence[str]], replicates: int, reference: str = "p_default_tabular") -> tuple[DataFrame | None, DataFrame]:
    """Stackers on fusion_fit, Platt on fusion_calibration, graded on validation: (comparison, wide predictions)."""
    scored, versions = rows.withColumn("reference", F.col(reference)), ["reference"]
    for name, tracks in variants.items():
        weights, intercept = fit_stacker(rows.filter("role = 'fusion_fit'"), tracks)
        scored = scored.withColumn(f"{name}_raw", fusion.stacker_probability(tracks, weights, intercept))
        platt = calibration.fit_platt(scored.filter("role = 'fusion_calibration'"), f"{name}_raw")
        scored = platt.apply(scored, f"{name}_raw", f"{name}_platt")
        versions += [f"{name}_raw", f"{name}_platt"]
    validation = scored.filter("role = 'validation'").select("loan_id", "role", "target", *versions).persist()
    long = scoring.to_versions(validation, versions, ["loan_id", "role", "target"])
    wide = fusion.wide_predictions(long, versions, "stacker-v1")
    if not replicates:
        return None, wide
    metrics = scoring.evaluate(long, by=["version"]).unpivot(["version"], list(scoring.METRICS), "metric", "value")
    deltas = paired_deltas(validation, fusion.version_pairs(versions), replicates)
    return deltas.join(metrics.withColumnRenamed("version", "candidate"), ["candidate", "metric"]).select(
        "candidate", "baseline", "metric", *[F.round(c, 4).alias(c) for c in ("value", "delta", "ci_low", "ci_high")]), wide


def stacker_artifact(rows: DataFrame, variant: str, tracks: Sequence[str]) -> dict:
    """A fitted variant as plain numbers."""
    weights, intercept = fit_stacker(rows.filter("role = 'fusion_fit'"), tracks)
    scored = rows.withColumn("_raw", fusion.stacker_probability(tracks, weights, intercept))
    platt = calibration.fit_platt(scored.filter("role = 'fusion_calibration'"), "_raw")
    return {"stacker_version": "stacker-v1", "variant": variant, "tracks": list(tracks), "coefficients": weights, "intercept": intercept,
            "fit_role": "fusion_fit", "calibrator": {"method": "platt", "fit_role": "fusion_calibration", **platt.details}}


ARTIFACT_SCHEMA = (
    "stacker_version string, variant string, tracks array<string>, coefficients array<double>, intercept double, fit_role string, "
    "calibrator struct<method: string, fit_role: string, slope: double, intercept: double, probability_clip: double>")


def artifact_table(spark: SparkSession, artifact: Mapping[str, object]) -> DataFrame:
    return spark.createDataFrame([artifact], ARTIFACT_SCHEMA)
