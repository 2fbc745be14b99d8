"""Model, calibration and fusion queries. Fitted tree and text models have no SQL form: those are
compared with brute force in the unit tests and run rows-only here."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gradeline import views
from gradeline.catalog.base import query, r9, rounded, s9
from gradeline.catalog.bootstrap import MARGINS, R
from gradeline.catalog.cohort import BASE_SQL, BLOCKS_SQL, FOLDS, SHARE
from gradeline.catalog.features import feature_rows
from gradeline.catalog.metrics import metric_sql
from gradeline.catalog.text import STOP
from gradeline.functions import columns as C
from gradeline.operators import boosting, calibration, fusion, linear, models, roles, scoring, terms, textfit
from gradeline.plans import features as P
from gradeline.plans import runs
from gradeline.session import spread

NUM, CAT = list(P.DEFAULT.numeric), list(P.DEFAULT.categorical)
CV, CV_FOLDS = 5, list(range(5))
TREES = boosting.BoostSettings(trees=100, max_depth=3)
TEXT = models.TextSettings(max_features=5000)
POINT = textfit.TextPoint(max_features=5000)


def role_rows(spark, sf, *names):
    rows = feature_rows(spark, sf)
    return rows.filter(F.col("role").isin(*names)) if names else rows


def fold_rows(spark, sf):
    return roles.expanding_folds(role_rows(spark, sf, "base_fit").persist(), CV, SHARE).persist()


def logistic(features=None, **settings):
    """A fitter over a subset of the feature list."""
    return linear.Logistic(tuple(NUM), tuple(CAT), models.LogisticSettings(**settings), None if features is None else tuple(features))


def pipeline(**settings):
    """The same model as a persistable Spark ML pipeline."""
    return lambda rows: models.fit_logistic(rows, NUM, CAT, models.LogisticSettings(**settings))


def trees(settings=TREES):
    return boosting.Booster(tuple(NUM), tuple(CAT), settings)


@query("logistic_coefficients")
def logistic_coefficients(spark, sf):
    """M2, M4: balanced logistic coefficients by name (a unit test solves the same optimum by Newton steps)."""
    model = pipeline()(role_rows(spark, sf, "base_fit").persist())
    return rounded(models.coefficients(model, NUM, CAT), 4)


@query("logistic_unweighted")
def logistic_unweighted(spark, sf):
    """The same model without class weights, graded on both held-out roles."""
    rows = role_rows(spark, sf).filter("role is not null").persist()
    scored = models.score(logistic(balanced=False)(rows.filter("role = 'base_fit'")), rows.filter("role <> 'base_fit'"))
    return rounded(scoring.evaluate(scored, by=["role"]), 4)


@query("logistic_run")
def logistic_run(spark, sf):
    """Features, fit on train, prediction contract, metrics of both splits."""
    return rounded(runs.logistic_baseline(role_rows(spark, sf).persist(), NUM, CAT), 4)


@query("out_of_fold_scores")
def out_of_fold_scores(spark, sf):
    """Out-of-fold scores of the expanding folds with their fold id, after the fold checks."""
    return runs.out_of_fold_export(fold_rows(spark, sf), CV_FOLDS, logistic(balanced=False), "tabular-oof-v1").withColumn(
        "p_default_tabular", r9("p_default_tabular", 4))


@query("boosted_trees")
def boosted_trees(spark, sf):
    """M5: histogram-boosted trees, missing numbers kept and sent where the gain is, graded on validation."""
    rows = role_rows(spark, sf, "base_fit", "validation").persist()
    scored = models.score(trees()(rows.filter("role = 'base_fit'")), rows.filter("role = 'validation'"))
    return rounded(scoring.evaluate(scored), 4)


_FS = " union all ".join(f"select '{v}' as version, fold, {v} as p, target from folds where part = 'holdout'" for v in ("p_a", "p_b"))
FOLD_METRICS = f"with {BASE_SQL}, {BLOCKS_SQL}, fs as ({_FS}), {metric_sql('fs', 'version, fold')}"
FOLD_LONG = "fl as (select version, fold, unnest(['roc_auc', 'pr_auc', 'brier_score', 'log_loss']) as metric, unnest([roc_auc, pr_auc, brier_score, log_loss]) as value from m)"


def holdout_metrics(spark, sf, by=("version", "fold")):
    rows = views.loans(spark, sf).filter("role = 'base_fit'")
    held = roles.expanding_folds(rows, FOLDS, SHARE).filter("part = 'holdout'")
    return scoring.evaluate(scoring.to_versions(held, ["p_a", "p_b"], ["fold", "purpose", "target"]), by=list(by))


@query("fold_metric_summary", f"{FOLD_METRICS}, {FOLD_LONG} select version, metric, {s9('avg(value)')} as mean, {s9('stddev_samp(value)')} as std, count(*) as folds from fl group by all", "loans")
def fold_metric_summary(spark, sf):
    """Mean and sample deviation of every metric over the folds."""
    return rounded(models.summarise_folds(holdout_metrics(spark, sf), ["version"]))


_PS = " union all ".join(f"select '{v}' as version, purpose, fold, {v} as p, target from folds where part = 'holdout'" for v in ("p_a", "p_b"))


@query("select_configuration", f"""with {BASE_SQL}, {BLOCKS_SQL}, fs as ({_PS}), {metric_sql('fs', 'version, purpose, fold')},
  tr as (select cast(row_number() over (order by version, purpose) as integer) as trial_id, cast(length(purpose) * pow(2, case version when 'p_a' then 3 else 2 end) as bigint) as complexity,
    avg(roc_auc) as mean, stddev_samp(roc_auc) as std from m group by version, purpose),
  md as (select quantile_cont(std, 0.5) as med from tr), st as (select tr.*, std <= 1.5::double * med as stable from tr, md),
  rf as (select * from st where stable order by mean desc, trial_id limit 1),
  el as (select st.*, greatest(0.002::double, rf.std / sqrt({FOLDS}::double)) as margin, st.stable and rf.mean - st.mean <= greatest(0.002::double, rf.std / sqrt({FOLDS}::double)) as eligible from st, rf)
  select trial_id, complexity, {s9('mean')} as mean, {s9('std')} as std, stable, eligible, {s9('margin')} as equivalence_margin,
    trial_id = (select trial_id from el where eligible order by complexity, trial_id limit 1) as selected from el""", "loans")
def select_configuration(spark, sf):
    """The predeclared selection rule over trials graded on the fold holdouts (a trial per score and segment)."""
    metrics = holdout_metrics(spark, sf, ("version", "purpose", "fold"))
    summary = metrics.groupBy("version", "purpose").agg(F.avg("roc_auc").alias("roc_auc_mean"), F.stddev_samp("roc_auc").alias("roc_auc_std"))
    from pyspark.sql import Window

    trials = summary.select(  # ten trials: one row per score and segment
        F.row_number().over(Window.orderBy("version", "purpose")).alias("trial_id"), F.lit("ok").alias("status"),
        C.leaf_bound(F.length("purpose"), F.when(F.col("version") == "p_a", 3).otherwise(2)).alias("complexity"), "roc_auc_mean", "roc_auc_std")
    out = models.select_configuration(trials, FOLDS)
    return out.select("trial_id", "complexity", r9("roc_auc_mean").alias("mean"), r9("roc_auc_std").alias("std"), "stable", "eligible",
                      r9("equivalence_margin").alias("equivalence_margin"), "selected")


@query("grid_rank", f"{FOLD_METRICS} select version, cast(fold as integer) as fold, {s9('pr_auc')} as pr_auc, cast(rank() over (order by pr_auc desc) as integer) as rank from m", "loans")
def grid_rank(spark, sf):
    """Competition rank of graded settings by descending average precision."""
    return models.rank_grid(holdout_metrics(spark, sf), "pr_auc").select("version", "fold", r9("pr_auc").alias("pr_auc"), "rank")


@query("search_trials")
def search_trials(spark, sf):
    """Declared trials cross-validated on all folds, a failing one recorded, one selected."""
    tried = [(100, 3, 0.1), (100, 2, 0.1), (60, 3, 0.1), (60, 2, 0.2), (30, 3, 0.3), (40, -1, 0.1)]
    declared = [{"trial_id": i, "complexity": t * 2 ** max(d, 0), "trees": t, "depth": d, "step": s} for i, (t, d, s) in enumerate(tried)]
    make = lambda trial: trees(replace(TREES, trees=trial["trees"], max_depth=trial["depth"], step=trial["step"]))
    log = models.run_trials(spark, fold_rows(spark, sf), CV_FOLDS, declared, make, budget=20)
    return models.select_configuration(log, CV).select(
        "trial_id", "status", "complexity", r9("roc_auc_mean", 4).alias("roc_auc_mean"), "stable", "eligible", "selected")


def comparison(pair):
    summary, deltas = pair
    means = summary.filter("metric in ('roc_auc', 'pr_auc', 'brier_score', 'log_loss')").select(
        F.col("version").alias("candidate"), "metric", r9("mean", 4).alias("fold_mean"), r9("std", 4).alias("fold_std"))
    return means.join(deltas.select("candidate", "metric", r9("delta", 4).alias("delta"), r9("ci_low", 4).alias("ci_low"),
                                    r9("ci_high", 4).alias("ci_high")), ["candidate", "metric"], "left")


@query("model_comparison")
def model_comparison(spark, sf):
    """Boosted trees against the logistic model on identical rows and folds."""
    variants = {"logistic": logistic(), "trees": trees()}
    return comparison(models.compare_variants(fold_rows(spark, sf), CV_FOLDS, variants, [("trees", "logistic")], R))


@query("family_ablation")
def family_ablation(spark, sf):
    """The model without each feature family in turn, against all features."""
    sets = P.feature_sets(P.DEFAULT, P.FAMILIES)
    variants = {name: logistic(names) for name, names in sets.items()}
    pairs = [(name, "all") for name in sets if name != "all"]
    return comparison(models.compare_variants(fold_rows(spark, sf), CV_FOLDS, variants, pairs, R))


@query("extra_feature_comparison")
def extra_feature_comparison(spark, sf):
    """The base features against base plus one joined feature, variants and pairs as data."""
    rows = role_rows(spark, sf, "base_fit")
    extra = views.loans(spark, sf).select("loan_id", F.col("p_b").alias("density"))
    long = roles.expanding_folds(rows.join(extra, "loan_id", "left").persist(), CV, SHARE).persist()
    whole = linear.Logistic((*NUM, "density"), tuple(CAT), models.LogisticSettings(balanced=False))
    variants = {"base": replace(whole, uses=(*NUM, *CAT)), "with_density": whole}
    return comparison(models.compare_variants(long, CV_FOLDS, variants, [("with_density", "base")], R))


@query("candidate_scores")
def candidate_scores(spark, sf):
    """Candidates fitted once, scoring sets checked disjoint and complete, one summary row each."""
    rows = role_rows(spark, sf).filter("role is not null").persist()
    fitted = {"logistic": logistic(balanced=False), "trees": trees()}
    return rounded(runs.candidate_predictions(rows, fitted, {"calibration": ["fusion_fit", "fusion_calibration"], "validation": ["validation"]}), 4)


@query("model_reload")
def model_reload(spark, sf):
    """A saved and reloaded model must give exactly the same scores."""
    rows = role_rows(spark, sf, "base_fit", "validation").persist()
    return runs.reload_equality(rows.filter("role = 'base_fit'"), rows.filter("role = 'validation'"), pipeline())


# ---- text models -----------------------------------------------------------------------------


def text_rows(spark, sf, n=1):
    docs = views.labelled_texts(spark, sf).filter("split <> 'test'").select("loan_id", "split", "role", "issue_month", "target", "desc").persist()
    return docs, terms.term_counts(docs, "desc", STOP, (1, n), key="loan_id").persist()


def listed_rows(spark, sf, *ns):
    """The same texts, and their words, from which terms of every length in ``ns`` are counted where they are read rather than kept."""
    docs = views.labelled_texts(spark, sf).filter("split <> 'test'").select("loan_id", "role", "issue_month", "target", "desc")
    words = terms.term_lists(spread(docs, "loan_id"), ["desc"], STOP, (1, max(ns)), ["loan_id"], counted=False)
    return docs.drop("desc").persist(), dict.fromkeys(ns, words)


@query("text_baseline")
def text_baseline(spark, sf):
    """TF-IDF and logistic fit on the fit role, graded per scoring role."""
    docs, counts = text_rows(spark, sf)
    return rounded(runs.text_baseline(docs, counts, TEXT), 4)


@query("text_out_of_fold")
def text_out_of_fold(spark, sf):
    """Five stratified random folds, the vocabulary refitted in each, one score per row."""
    docs, lists = listed_rows(spark, sf, 1)
    folded = roles.stratified_folds(docs.select("loan_id", "target"), "loan_id", CV, "text-kfold")
    members = textfit.random_members(docs, folded, CV)
    return textfit.fit_points(docs, lists, members, [POINT]).select("loan_id", "fold", "target", r9("p", 4).alias("p"))


GRID = [textfit.TextPoint(m, n, c, balanced=True) for m in (3000, 5000, 10_000) for n in (1, 2) for c in (0.01, 0.1, 1.0, 10.0)]


@query("text_grid")
def text_grid(spark, sf):
    """24 points of vocabulary size, n-gram and penalty on five time folds, ranked by average precision."""
    docs, lists = listed_rows(spark, sf, 1, 2)
    fit = docs.filter("role = 'base_fit'")
    members = roles.expanding_folds(fit.select("loan_id", "issue_month"), CV, 0.4).select("fold", "part", "loan_id")
    scored = textfit.fit_points(docs, lists, members, GRID).persist()
    metrics = scoring.evaluate(scored, by=["point", "fold"]).groupBy("point").agg(F.avg("pr_auc").alias("mean"), F.stddev_samp("pr_auc").alias("std"))
    settings = spark.createDataFrame([(k, p.max_features, p.max_ngram, p.C) for k, p in enumerate(GRID)], "point int, max_features int, max_ngram int, C double")
    return rounded(models.rank_grid(settings.join(metrics, "point").drop("point")), 4)


def variant_rows(spark, sf):
    docs, lists = listed_rows(spark, sf, 1)
    folded = roles.stratified_folds(docs.filter("role = 'base_fit'").select("loan_id", "target"), "loan_id", CV, "text-crossfit")
    return textfit.calibration_variants(docs.select("loan_id", "target", "role"), lists, folded, CV, POINT, "base_fit", "fusion_calibration", "validation")


@query("calibration_variants")
def calibration_variants(spark, sf):
    """One text model raw, calibrated out of fold, by a later period, and cross-fitted (a calibrator per fold, averaged)."""
    out = scoring.evaluate(variant_rows(spark, sf), by=["variant"])
    return rounded(out.select("variant", "rows", "positives", "mean_p", *scoring.METRICS), 4)


@query("variant_sweep")
def variant_sweep(spark, sf):
    """The threshold sweep of every calibration variant."""
    return rounded(scoring.threshold_sweep(variant_rows(spark, sf), [k / 20 for k in range(1, 20)], by=["variant"]), 4)


@query("text_score_export")
def text_score_export(spark, sf):
    """Margin and probability of the scoring roles, checked by the six-column contract before they are handed on."""
    docs, counts = text_rows(spark, sf)
    export = runs.text_export(docs.drop("desc"), counts, TEXT, "text-fusion-v2")
    return export.withColumn("raw_margin", r9("raw_margin", 3)).withColumn("raw_prob", r9("raw_prob", 3))


@query("text_top_terms")
def text_top_terms(spark, sf):
    """Strongest coefficients of the fitted text model with document frequency."""
    docs, counts = text_rows(spark, sf)
    fitted = models.fit_text(docs.filter("role = 'base_fit'").drop("desc"), counts, TEXT)
    return rounded(terms.top_terms(models.text_coefficients(fitted), 10), 3)


@query("batch_scorer")
def batch_scorer(spark, sf):
    """A text model fitted on the labelled texts scores the conversations in Arrow batches, loaded once per worker (a unit
    test compares it with the model's own scores)."""
    docs, counts = text_rows(spark, sf)
    fitted = models.fit_text(docs.filter("role = 'base_fit'").drop("desc"), counts, TEXT)
    score = models.batch_scorer(models.text_scorer(fitted, STOP, TEXT))
    rows = views.table(spark, sf, "conversations").select("conv_id", "turn", score(F.col("text")).alias("s"))
    return rows.select("conv_id", "turn", r9("s.raw_margin", 3).alias("raw_margin"), r9("s.raw_prob", 3).alias("raw_prob"))


# ---- calibration -----------------------------------------------------------------------------


def newton_sql(eps: str, penalty: int, steps: int = 14) -> str:
    """CTEs xs and n0..n{steps}: Newton steps of the two-parameter logistic fit on logit(p_a)."""
    out = [f"""xs as materialized (select ln(least(greatest(p_a, {eps}), 1 - {eps}) / (1 - least(greatest(p_a, {eps}), 1 - {eps}))) as x, target as y from loans where role = 'fusion_calibration')""",
           "n0 as materialized (select 0::double as a, 0::double as b)"]
    for k in range(1, steps + 1):
        out.append(f"""n{k} as materialized (select a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) as a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) as b from (
    select any_value(a) as a, any_value(b) as b, sum((q - y) * x) + {penalty} * any_value(a) as ga, sum(q - y) as gb, sum(q * (1 - q) * x * x) + {penalty} as haa,
      sum(q * (1 - q) * x) as hab, sum(q * (1 - q)) as hbb from (select xs.*, n.a, n.b, 1 / (1 + exp(-(n.a * x + n.b))) as q from xs, n{k - 1} n)))""")
    return ", ".join(out)


def calibrator_row(spark, calibrator, digits=5):
    return spark.createDataFrame([(float(calibrator.details["slope"]), float(calibrator.details["intercept"]))], "slope double, intercept double").select(
        r9("slope", digits).alias("slope"), r9("intercept", digits).alias("intercept"))


@query("platt_fit", f"with {newton_sql('1e-6::double', 0)} select {s9('a', 5)} as slope, {s9('b', 5)} as intercept from n14", "loans")
def platt_fit(spark, sf):
    """The unpenalised logistic fit on logit(p)."""
    return calibrator_row(spark, calibration.fit_platt(views.loans(spark, sf).filter("role = 'fusion_calibration'"), "p_a"))


@query("platt_penalised", f"with {newton_sql('1e-12::double', 1)} select {s9('a', 5)} as slope, {s9('b', 5)} as intercept from n14", "loans")
def platt_penalised(spark, sf):
    """The penalised variant (C = 1) of the text track."""
    rows = views.loans(spark, sf).filter("role = 'fusion_calibration'")
    return calibrator_row(spark, calibration.fit_platt(rows, "p_a", eps=1e-12, penalised=True))


ISOTONIC_SQL = f"""with g as (select p_a as p, sum(target) as pos, count(*) as n, row_number() over (order by p_a) as i from loans where role = 'fusion_calibration' group by p_a),
  c as (select i, p, sum(pos) over (order by i) as cp, sum(n) over (order by i) as cn, pos, n from g),
  m as (select a.i as i, b.i as j, (b.cp - a.cp + a.pos)::double / (b.cn - a.cn + a.n)::double as mean from c a join c b on b.i >= a.i),
  s as (select i, j, min(mean) over (partition by i order by j rows between current row and unbounded following) as low from m),
  f as (select j as i, max(low) as fit from s group by j)
  select p, {s9('least(greatest(fit, 1e-6::double), 1 - 1e-6::double)')} as calibrated from f join c using (i)"""


def isotonic_scores(spark, sf, **options):
    rows = views.loans(spark, sf).filter("role = 'fusion_calibration'")
    scores = rows.groupBy(F.col("p_a").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(calibration.fit_isotonic(rows, "p_a", **options).apply(scores, "p", "calibrated").select("p", "calibrated"))


@query("isotonic_fit", ISOTONIC_SQL, "loans")
def isotonic_fit(spark, sf):
    """The isotonic fit at every calibration score (its SQL is the max-min formula)."""
    return isotonic_scores(spark, sf)


@query("isotonic_ranges", ISOTONIC_SQL, "loans")
def isotonic_ranges(spark, sf):
    """The same fit from ranges of about forty scores, whose ends are pooled until none violate the order."""
    return isotonic_scores(spark, sf, rows_per_range=40)


def calibration_rows(spark, sf):
    rows = views.loans(spark, sf).filter(F.col("role").isin("fusion_calibration", "validation"))
    return rows.select("loan_id", F.when(F.col("role") == "validation", "validation").otherwise("calibration").alias("set"), "target", "p_a", "p_b").persist()


@query("calibration_run", f"""with {newton_sql('1e-6::double', 0)}, s as (select case role when 'validation' then 'validation' else 'calibration' end as "set", method, p, target from (
    select role, 'raw' as method, p_a as p, target from loans where role in ('fusion_calibration', 'validation')
    union all select role, 'platt', 1 / (1 + exp(-(a * ln(p_a / (1 - p_a)) + b))), target from loans, n14 where role in ('fusion_calibration', 'validation'))), {metric_sql('s', '"set", method')}
  select "set", method, rows, positives, {s9('mean_p', 5)} as mean_p, {s9('roc_auc', 5)} as roc_auc, {s9('pr_auc', 5)} as pr_auc, {s9('brier_score', 5)} as brier_score, {s9('log_loss', 5)} as log_loss from m""", "loans")
def calibration_run(spark, sf):
    """Fitted on calibration rows only, every method graded on both sets in one job."""
    long, _ = calibration.calibrate_all(calibration_rows(spark, sf), ["p_a"], "calibration", ["raw", "platt"])
    out = scoring.evaluate(long, by=["set", "method"])
    return rounded(out.select("set", "method", "rows", "positives", "mean_p", *scoring.METRICS), 5)


@query("candidate_calibration")
def candidate_calibration(spark, sf):
    """Every candidate, method and set in one metric table (isotonic included)."""
    long, _ = calibration.calibrate_all(calibration_rows(spark, sf), ["p_a", "p_b"], "calibration")
    return rounded(scoring.evaluate(long, by=["candidate", "method", "set"]), 6)


@query("method_choice")
def method_choice(spark, sf):
    """Pairwise method deltas, the sequential method choice and the champion rule."""
    return runs.calibration_decision(calibration_rows(spark, sf), "p_a", "p_b", MARGINS, replicates=R)


@query("recorded_metrics", f"""with s as (select case role when 'validation' then 'validation' else 'calibration' end as "set", p_a as p, target from loans where role in ('fusion_calibration', 'validation')), {metric_sql('s', '"set"')},
  l as (select "set", unnest(['roc_auc', 'pr_auc', 'brier_score', 'log_loss']) as metric, unnest([roc_auc, pr_auc, brier_score, log_loss]) as value from m)
  select "set", metric, case when metric = 'log_loss' and "set" = 'validation' then false else true end as reproduced from l""", "loans")
def recorded_metrics(spark, sf):
    """Metric rows must reproduce the recorded ones within 1e-6 (one recorded value is off by 1e-5)."""
    rows = calibration_rows(spark, sf)
    now = scoring.evaluate(rows, "p_a", by=["set"]).unpivot(["set"], list(scoring.METRICS), "metric", "value")
    off = F.when((F.col("metric") == "log_loss") & (F.col("set") == "validation"), 1e-5).otherwise(0.0)
    recorded = now.select("set", "metric", (F.col("value") + off).alias("recorded"))
    return runs.reproduced(now, recorded, ["set", "metric"], 1e-6).select("set", "metric", "reproduced")


@query("calibrated_export", f"""with {newton_sql('1e-6::double', 0)} select loan_id, split, p_a as p_default_tabular_raw, {s9('1 / (1 + exp(-(a * ln(p_a / (1 - p_a)) + b)))', 5)} as p_default_tabular_calibrated,
  'logistic_regression' as model_name, 'tabular-v1' as model_version, 'calibration-v1' as calibration_version from loans, n14 where role = 'validation'""", "loans")
def calibrated_export(spark, sf):
    """Raw and calibrated scores side by side for the validation rows."""
    rows = views.loans(spark, sf)
    platt = calibration.fit_platt(rows.filter("role = 'fusion_calibration'"), "p_a")
    out = platt.apply(rows.filter("role = 'validation'"), "p_a", "_c")
    return out.select("loan_id", "split", F.col("p_a").alias("p_default_tabular_raw"), r9("_c", 5).alias("p_default_tabular_calibrated"),
                      F.lit("logistic_regression").alias("model_name"), F.lit("tabular-v1").alias("model_version"), F.lit("calibration-v1").alias("calibration_version"))


# ---- fusion ----------------------------------------------------------------------------------

# Stored numbers of one fitted stacker, its calibrator and the tabular fallback.
ARTIFACT = {
    "stacker_version": "stacker-v1", "variant": "tabular_text", "tracks": ["tabular", "text"], "coefficients": [2.75, 1.5], "intercept": -2.25,
    "calibrator": {"slope": 1.1, "intercept": -0.05, "probability_clip": 1e-6},
    "fallback": {"slope": 0.9, "intercept": 0.125, "probability_clip": 1e-6, "version": "calibration-v1"},
}


def stacking_rows(spark, sf):
    return views.loans(spark, sf).filter(F.col("role").isin(*views.SCORING_ROLES)).select(
        "loan_id", "role", "target", F.col("p_a").alias("p_default_tabular"), F.col("p_b").alias("p_default_text")).persist()


@query("stacker")
def stacker(spark, sf):
    """Stacker on one role, Platt on the next, every version graded on validation with paired intervals."""
    return runs.stacking(stacking_rows(spark, sf), {"tabular_only": ["tabular"], "tabular_text": ["tabular", "text"]}, replicates=R)[0]


@query("stacker_predictions")
def stacker_predictions(spark, sf):
    """All validation versions side by side."""
    out = runs.stacking(stacking_rows(spark, sf), {"tabular_only": ["tabular"], "tabular_text": ["tabular", "text"]}, replicates=0)[1]
    return rounded(out, 3)


@query("stacker_artifact")
def stacker_artifact(spark, sf):
    """The fitted stacker as plain numbers, its agreement with the settings checked."""
    artifact = runs.stacker_artifact(stacking_rows(spark, sf), "tabular_text", ["tabular", "text"])
    table = runs.artifact_table(spark, artifact)
    return fusion.artifact_checks(table, {"variant": "tabular_text", "tracks": ["tabular", "text"], "fit_role": "fusion_fit", "calibrator.fit_role": "fusion_calibration"})


PREDICT_INPUT = """pi as (select loan_id, case when annual_inc < -500 then null else p_a end as t, case when purpose = 'BUILDING' then null else p_b end as x,
    case when purpose = 'BUILDING' then false when loan_amnt > 400000 then false else true end as u from loans where role = 'validation')"""


def predict_input(spark, sf):
    rows = views.loans(spark, sf).filter("role = 'validation'")
    building = F.col("purpose") == "BUILDING"
    return rows.select(
        "loan_id", F.when(F.col("annual_inc") < -500, F.lit(None)).otherwise(F.col("p_a")).alias("p_default_tabular"),
        F.when(building, F.lit(None)).otherwise(F.col("p_b")).alias("p_default_text"),
        F.when(building, False).when(F.col("loan_amnt") > 400000, False).otherwise(True).alias("text_usable"))


@query("fallback_scores", f"""with {PREDICT_INPUT}, r as (select *, case when t is null then 'missing_score' when not u and x is not null then 'text_score_without_text' when u and x is null then 'missing_score' end as why from pi),
  q as (select *, case when u then 1 / (1 + exp(-(2.75::double * t + 1.5::double * x - 2.25::double))) else t end as s from r),
  z as (select *, case when u then 1.1::double else 0.9::double end * ln(s / (1 - s)) + case when u then -0.05::double else 0.125::double end as m from q)
  select loan_id, u as text_usable, case when why is null then {s9('1 / (1 + exp(-m))')} end as p_default, case when why is null then case when u then 'fusion_stacker' else 'tabular_fallback' end end as source,
    case when why is null then not u end as fallback, case when why is null then case when u then 'tabular,text' else 'tabular' end end as tracks_used,
    case when why is null then case when u then 'stacker-v1/tabular_text' else 'calibration-v1' end end as model_version, why as reject_reason from z""", "loans")
def fallback_scores(spark, sf):
    """Stacker plus Platt with usable text, calibrated tabular without, invalid input refused with a reason."""
    out = fusion.predict(predict_input(spark, sf), ARTIFACT).drop("p_default_tabular", "p_default_text")
    return out.withColumn("p_default", r9("p_default"))


@query("reference_scores", f"""select loan_id, p_a as p_reference_raw, {s9('1 / (1 + exp(-(0.9::double * ln(p_a / (1 - p_a)) + 0.125::double)))')} as p_reference from loans where role = 'validation'""", "loans")
def reference_scores(spark, sf):
    """Reference scores aligned to the graded ids, one version, finite and in range."""
    rows = views.loans(spark, sf).filter("role = 'validation'")
    reference = rows.select("loan_id", F.col("p_a").alias("p_reference_raw"), C.platt(F.col("p_a"), 0.9, 0.125, 1e-6).alias("p_reference"), F.lit("v1").alias("model_version"))
    return runs.reference_scores(reference, rows, "v1").withColumn("p_reference", r9("p_reference"))


@query("comparison_pairs", """with v as (select distinct unnest(['reference', 'tabular_only_raw', 'tabular_only_platt', 'tabular_text_raw', 'tabular_text_platt']) as v from loans),
  p as (select v as candidate, 'reference' as baseline from v where v <> 'reference' union all select v, 'tabular_only_platt' from v where v like '%_platt' and v <> 'tabular_only_platt')
  select candidate, baseline, count(*) as rows from p, loans where role = 'validation' group by all""", "loans")
def comparison_pairs(spark, sf):
    """The comparison pairs, with the validation rows each is graded on."""
    pairs = fusion.version_pairs(["reference", "tabular_only_raw", "tabular_only_platt", "tabular_text_raw", "tabular_text_platt"])
    rows = views.loans(spark, sf).filter("role = 'validation'").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(b).alias("baseline")) for c, b in pairs])), "rows")


