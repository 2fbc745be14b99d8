"""Metric, curve and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline import views
from gradeline.catalog.base import query, r9, rounded, s9
from gradeline.functions import columns as C
from gradeline.operators import policy, scoring

GRID = C.threshold_grid(0.0, 1.0, 0.01)
SWEEP = [round(0.10 + 0.05 * i, 2) for i in range(11)]
RATES = [0.50, 0.70, 0.80, 0.90]


def doubles(values) -> str:
    return ", ".join(f"cast({v!r} as double)" for v in values)


def validation(spark, sf):
    return views.loans(spark, sf).filter("split = 'validation'")


def long_scores(spark, sf, keep=("loan_id", "split", "role", "target")):
    return scoring.to_versions(views.loans(spark, sf).filter("split <> 'test'"), ["p_a", "p_b"], keep)


# Metric arithmetic shared by several SQL texts: from groups(k..., p, pos, neg) to one row per k.
def metric_sql(source: str, keys: str = "") -> str:
    """CTEs g, c and m over ``source`` (keys, p, target)."""
    part = f"partition by {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    return f"""g as (select {k}p, sum(target) as pos, sum(1 - target) as neg from {source} group by {k}p),
c as (select *, sum(pos) over ({part}order by p desc) as tp, sum(neg) over ({part}order by p desc) as fp from g),
m as (select {k}cast(sum(pos + neg) as bigint) as rows, cast(sum(pos) as bigint) as positives,
  sum(pos)::double / sum(pos + neg)::double as prevalence, sum(p * (pos + neg)) / sum(pos + neg)::double as mean_p,
  case when sum(pos) > 0 and sum(neg) > 0 then sum((tp - pos / 2.0::double) * neg) / (sum(pos)::double * sum(neg)::double) end as roc_auc,
  case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (tp::double / (tp + fp)::double)) / sum(pos)::double end as pr_auc,
  sum(pos * (1 - p) * (1 - p) + neg * p * p) / sum(pos + neg)::double as brier_score,
  sum(-pos * ln(least(greatest(p, 2.220446049250313e-16::double), 1 - 2.220446049250313e-16::double))
      - neg * ln(1 - least(greatest(p, 2.220446049250313e-16::double), 1 - 2.220446049250313e-16::double)))
    / sum(pos + neg)::double as log_loss
  from c {group})"""


METRIC_OUT = f"""rows, positives, {s9('prevalence')} as prevalence, {s9('mean_p')} as mean_p,
  {s9('mean_p - prevalence')} as mean_p_minus_prevalence, {s9('roc_auc')} as roc_auc, {s9('pr_auc')} as pr_auc,
  {s9('brier_score')} as brier_score, {s9('log_loss')} as log_loss"""


@query("metric_row", f"with s as (select p_a as p, target from loans where split = 'validation'), {metric_sql('s')} "
       f"select {METRIC_OUT} from m", "loans")
def metric_row(spark, sf):
    """The metric row of one score on the validation split."""
    return rounded(scoring.evaluate(validation(spark, sf), "p_a"))


@query("metric_rows_by_version", f"""with s as (select role, 'p_a' as version, p_a as p, target from loans where split <> 'test'
  union all select role, 'p_b', p_b, target from loans where split <> 'test'), {metric_sql('s', 'role, version')}
  select role, version, {METRIC_OUT} from m""", "loans")
def metric_rows_by_version(spark, sf):
    """E11 for every role and score version in one job."""
    return rounded(scoring.evaluate(long_scores(spark, sf), by=["role", "version"]))


@query("mean_risk", f"""select split, {s9('avg(p_a)')} as mean_p, {s9('avg(target)')} as observed_rate,
  {s9('avg(p_a) - avg(target)')} as gap from loans where split <> 'test' group by split""", "loans")
def mean_risk(spark, sf):
    """Mean predicted risk against the observed rate."""
    return rounded(views.loans(spark, sf).filter("split <> 'test'").groupBy("split").agg(
        F.avg("p_a").alias("mean_p"), F.avg("target").alias("observed_rate"),
        (F.avg("p_a") - F.avg("target")).alias("gap")))


@query("subgroup_metrics", f"""with s as (
  select 'month' as grouping, issue_month as "group", version, p, target, hit from (
    select issue_month, 'p_a' as version, p_a as p, target, annual_inc < 0 as hit from loans where split = 'validation'
    union all select issue_month, 'p_b', p_b, target, annual_inc < 0 from loans where split = 'validation')
  union all select 'keyword_hit', cast(hit as varchar), version, p, target, hit from (
    select 'p_a' as version, p_a as p, target, annual_inc < 0 as hit from loans where split = 'validation'
    union all select 'p_b', p_b, target, annual_inc < 0 from loans where split = 'validation')),
  {metric_sql('s', 'grouping, "group", version')},
  h as (select grouping, "group", version, avg(hit::int) as hit_rate from s group by all)
  select grouping, "group", version, rows, positives, {s9('hit_rate')} as hit_rate, {s9('roc_auc')} as roc_auc,
    {s9('pr_auc')} as pr_auc, {s9('brier_score')} as brier_score, {s9('log_loss')} as log_loss
  from m join h using (grouping, "group", version)""", "loans")
def subgroup_metrics(spark, sf):
    """The same metrics per month and per flag, from one pass over the rows."""
    rows = validation(spark, sf).withColumn("hit", F.col("annual_inc") < 0)
    rows = scoring.to_versions(rows, ["p_a", "p_b"], ["issue_month", "hit", "target"])
    keyed = rows.withColumn("_g", F.explode(F.array(
        F.struct(F.lit("month").alias("grouping"), F.col("issue_month").alias("group")),
        F.struct(F.lit("keyword_hit").alias("grouping"), F.col("hit").cast("string").alias("group")))))
    keyed = keyed.select("_g.*", "version", "p", "target", "hit")
    by = ["grouping", "group", "version"]
    rates = keyed.groupBy(*by).agg(F.avg(F.col("hit").cast("int")).alias("hit_rate"))
    metrics = scoring.evaluate(keyed, by=by)
    return rounded(metrics.join(rates, by).select(*by, "rows", "positives", "hit_rate", *scoring.METRICS))


@query("f1_best", f"""with g as (select p_a as p, sum(target) as pos, sum(1 - target) as neg from loans where split = 'validation' group by 1),
  c as (select p, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp, sum(pos) over () as n from g),
  f as (select p, 2.0::double * tp / (tp + fp + n)::double as f1 from c),
  h as (select 2.0::double * count(*) filter (p_a >= 0.5 and target = 1)
      / (count(*) filter (p_a >= 0.5) + count(*) filter (target = 1))::double as half from loans where split = 'validation')
  select {s9('half')} as f1_at_half, {s9('max(f1)')} as f1_best, (select min(p) from f where f1 = (select max(f1) from f)) as f1_best_threshold
  from f, h group by half""", "loans")
def f1_best(spark, sf):
    """E5: F1 at 0.5, best F1 and the lowest threshold that reaches it."""
    rows = validation(spark, sf)
    best = scoring.best_f1(scoring.ranked_groups(rows, "p_a"))
    half = rows.agg(scoring.f1_at(F.col("p_a"), F.col("target"), 0.5).alias("f1_at_half"))
    return best.join(half).select(r9("f1_at_half").alias("f1_at_half"), r9("f1_best").alias("f1_best"), "f1_best_threshold")


@query("confusion", """select split, count(*) filter (p_a < 0.5 and target = 0) as tn, count(*) filter (p_a >= 0.5 and target = 0) as fp,
  count(*) filter (p_a < 0.5 and target = 1) as fn, count(*) filter (p_a >= 0.5 and target = 1) as tp
  from loans where split <> 'test' group by split""", "loans")
def confusion(spark, sf):
    """Confusion counts at one named threshold."""
    return views.loans(spark, sf).filter("split <> 'test'").groupBy("split").agg(
        *scoring.confusion(F.col("p_a"), F.col("target"), 0.5))


@query("curve_points", f"""with g as (select p_a as p, sum(target) as pos, sum(1 - target) as neg from loans where split = 'validation' group by 1),
  c as (select p, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp, sum(pos) over () as n, sum(neg) over () as m from g)
  select p as threshold, {s9('fp::double / m::double')} as fpr, {s9('tp::double / n::double')} as tpr,
    {s9('tp::double / (tp + fp)::double')} as "precision" from c""", "loans")
def curve_points(spark, sf):
    """ROC and precision-recall points per distinct score."""
    return scoring.curve_points(validation(spark, sf), "p_a").select(
        "threshold", r9("fpr").alias("fpr"), r9("tpr").alias("tpr"), r9("precision").alias("precision"))


@query("threshold_sweep", f"""with t as (select unnest([{doubles(SWEEP)}]) as threshold),
  k as (select threshold, count(*) filter (p_a < threshold and target = 0) as tn, count(*) filter (p_a >= threshold and target = 0) as fp,
    count(*) filter (p_a < threshold and target = 1) as fn, count(*) filter (p_a >= threshold and target = 1) as tp, count(*) as n
    from (select * from loans where split = 'validation'), t group by threshold),
  r as (select *, case when tp + fp > 0 then tp::double / (tp + fp)::double else 0 end as pr,
    case when tp + fn > 0 then tp::double / (tp + fn)::double else 0 end as re from k)
  select threshold, tn, fp, fn, tp, {s9('pr')} as "precision", {s9('re')} as recall,
    {s9('case when pr + re > 0 then 2.0::double * pr * re / (pr + re) else 0 end')} as f1,
    case when tp > 0 then {s9('fp::double / tp::double')} else 'Infinity'::double end as false_positives_per_true_positive,
    {s9('(tp + fp)::double / n::double')} as flagged_rate from r""", "loans")
def threshold_sweep(spark, sf):
    """Confusion, precision, recall and cost at each threshold."""
    out = scoring.threshold_sweep(validation(spark, sf), SWEEP, "p_a")
    keep = "false_positives_per_true_positive"
    return out.select("threshold", "tn", "fp", "fn", "tp", *[r9(c).alias(c) for c in ("precision", "recall", "f1", "flagged_rate")],
                      F.when(F.col(keep) == float("inf"), F.col(keep)).otherwise(r9(keep)).alias(keep))


@query("recall_threshold", f"""with g as (select p_a as p, sum(target) as pos, sum(1 - target) as neg from loans where split = 'validation' group by 1),
  c as (select p, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp, sum(pos) over () as n, sum(neg) over () as m from g),
  t as (select unnest([{doubles([0.7, 0.8])}]) as target_recall),
  b as (select target_recall, max(p) as p from c, t where tp::double / n::double >= target_recall group by 1)
  select target_recall, p as threshold, {s9('tp::double / n::double')} as recall, {s9('tp::double / (tp + fp)::double')} as "precision",
    cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(n - tp as bigint) as fn, cast(m - fp as bigint) as tn,
    {s9('fp::double / tp::double')} as false_positives_per_true_positive, {s9('(tp + fp)::double / (n + m)::double')} as flagged_rate
  from b join c using (p)""", "loans")
def recall_threshold(spark, sf):
    """Highest threshold that reaches each target recall."""
    return scoring.threshold_for_recall(validation(spark, sf), [0.7, 0.8], "p_a").select(
        "target_recall", "threshold", "tp", "fp", "fn", "tn",
        *[r9(c).alias(c) for c in ("recall", "precision", "false_positives_per_true_positive", "flagged_rate")])


def _reliability_sql(edges: str) -> str:
    return f"""with v as (select p_a as p, target from loans where split = 'validation'), e as ({edges})
  select cast(len(list_filter(edges, lambda x: x < p)) as integer) as bin, count(*) as rows, {s9('avg(p)')} as mean_predicted,
    {s9('avg(target)')} as observed_rate from v, e group by 1"""


@query("reliability_quantile", _reliability_sql(
    "select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from v"), "loans")
def reliability_quantile(spark, sf):
    """Reliability curve over quantile bins; empty bins are absent."""
    return rounded(scoring.reliability(validation(spark, sf), 10, "quantile", "p_a"))


@query("reliability_uniform", _reliability_sql(f"select [{doubles([i / 10 for i in range(1, 10)])}] as edges"), "loans")
def reliability_uniform(spark, sf):
    """Reliability curve over equal-width bins."""
    return rounded(scoring.reliability(validation(spark, sf), 10, "uniform", "p_a"))


@query("score_histogram", """select split, cast(least(floor(p_a * 50), 49) as bigint) as bin, count(*) as rows
  from loans where split <> 'test' group by all""", "loans")
def score_histogram(spark, sf):
    """Fixed-width score histogram."""
    return scoring.histogram(views.loans(spark, sf).filter("split <> 'test'"), 50, "p_a", ["split"])


@query("score_quantiles", f"""select role, prob, {s9('q')} as quantile from (
  select role, unnest([{doubles([0.05, 0.25, 0.5, 0.75, 0.95])}]) as prob, unnest(quantile_cont(p_b, [0.05, 0.25, 0.5, 0.75, 0.95])) as q
  from loans where role is not null group by role)""", "loans")
def score_quantiles(spark, sf):
    """Exact interpolated quantiles per role through ranked distinct values (used by E9, A5, A9, M2)."""
    from gradeline.operators.ordering import exact_quantiles

    rows = views.loans(spark, sf).filter("role is not null")
    return rounded(exact_quantiles(rows, "p_b", [0.05, 0.25, 0.5, 0.75, 0.95], ["role"]))


@query("policy_curve", f"""with t as (select unnest([{doubles(GRID)}]) as threshold),
  s as (select 'p_a' as version, p_a as p, target from loans where split = 'validation' union all
        select 'p_b', p_b, target from loans where split = 'validation'),
  k as (select version, threshold, count(*) filter (p < threshold) as approved, coalesce(sum(target) filter (p < threshold), 0)::bigint as events,
    count(*) as n from s, t group by all)
  select version, threshold, approved, {s9('approved::double / n::double')} as approval_rate, events as events_among_approved,
    case when approved > 0 then {s9('events::double / approved::double')} end as event_rate_among_approved from k""", "loans")
def policy_curve(spark, sf):
    """Approvals and events below every threshold, two scores in one job."""
    rows = scoring.to_versions(validation(spark, sf), ["p_a", "p_b"], ["target"])
    return rounded(policy.policy_table(rows, GRID, by=["version"]))


@query("approval_rates", f"""with r as (select target, row_number() over (order by p_a, loan_id) as k, count(*) over () as n
    from loans where split = 'validation'),
  c as (select k, n, sum(target) over (order by k) as events from r),
  t as (select unnest([{doubles(RATES)}]) as approval_rate)
  select approval_rate, k as approved, cast(events as bigint) as events_among_approved, {s9('events::double / k::double')} as event_rate_among_approved
  from t, c where k = greatest(cast(round_even(approval_rate * n, 0) as bigint), 1)""", "loans")
def approval_rates(spark, sf):
    """Event rate among the lowest-risk rows at fixed approval rates."""
    return rounded(policy.rate_at_approval(validation(spark, sf), RATES, "p_a"))


@query("approval_curve", f"""with r as (select p_a, loan_id, target, row_number() over (order by p_a, loan_id) as approved, count(*) over () as n
    from loans where split = 'validation')
  select approved, {s9('approved::double / n::double')} as approval_rate,
    {s9('sum(target) over (order by approved)::double / approved::double')} as event_rate_among_approved from r""", "loans")
def approval_curve(spark, sf):
    """The threshold-free curve, one point per approved row."""
    return rounded(policy.approval_curve(validation(spark, sf), "p_a"))


@query("constant_baseline", f"""with b as (select avg(target) as base from loans where split = 'train')
  select l.split, count(*) as rows, {s9('max(base)')} as p, {s9('avg((base - target) * (base - target))')} as brier_score,
   {s9('avg(-target * ln(base) - (1 - target) * ln(1 - base))')} as log_loss, {s9('0.5')} as roc_auc, {s9('avg(target)')} as pr_auc
  from loans l, b where l.split <> 'test' group by l.split""", "loans")
def constant_baseline(spark, sf):
    """M1: every row gets the training base rate."""
    from gradeline.operators.models import constant_scores

    rows = views.loans(spark, sf).filter("split <> 'test'")
    scored = constant_scores(rows.filter("split = 'train'"), rows)
    out = scoring.evaluate(scored, "p", by=["split"])
    return rounded(out.select("split", "rows", F.col("mean_p").alias("p"), "brier_score", "log_loss", "roc_auc", "pr_auc"))


@query("interval_verdict", f"""with g as (select role, p_a as p, sum(target) as pos, sum(1 - target) as neg from loans where role is not null group by all),
  c as (select *, sum(pos) over (partition by role order by p desc) as tp from g),
  a as (select role, sum((tp - pos / 2.0::double) * neg) / (sum(pos)::double * sum(neg)::double) as auc, sum(pos)::double as n1, sum(neg)::double as n0 from c group by role),
  v as (select role, auc, auc - 1.96::double * sqrt(auc * (1 - auc) / least(n1, n0)) as low from a)
  select role, {s9('auc')} as roc_auc, {s9('low')} as ci_low,
    case when low > 0.6 then 'PASS' when auc > 0.6 then 'INCONCLUSIVE' else 'FAIL' end as verdict from v""", "loans")
def interval_verdict(spark, sf):
    """PASS / INCONCLUSIVE / FAIL of an interval against a target AUC."""
    out = scoring.evaluate(views.loans(spark, sf).filter("role is not null"), "p_a", by=["role"])
    auc, smaller = F.col("roc_auc"), F.least("positives", F.col("rows") - F.col("positives"))
    low = auc - F.lit(1.96) * F.sqrt(auc * (1 - auc) / smaller)
    return out.select("role", r9(auc).alias("roc_auc"), r9(low).alias("ci_low"),
                      scoring.interval_verdict(auc, low, 0.6).alias("verdict"))
