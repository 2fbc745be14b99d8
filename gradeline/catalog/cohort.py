"""Cohort, split, role and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline import views
from gradeline.catalog.base import query, rounded, s9
from gradeline.functions import columns as C
from gradeline.operators import roles
from gradeline.plans import cohort

FOLDS, SHARE = 5, 0.4

COHORT_SQL = """reg as (select 'lc_' || lpad(cast(source_row_number as varchar), 9, '0') as loan_id, source_row_number,
    strftime(try_strptime(issue_d, '%b-%Y'), '%Y-%m') as issue_month, loan_status,
    lower(trim("desc", ' ' || chr(9))) as marker from raw_loans
    where loan_status in ('Fully Paid', 'Charged Off') and trim("desc", ' ' || chr(9)) <> ''
      and try_strptime(issue_d, '%b-%Y') between timestamp '1995-01-01' and timestamp '2001-12-01'),
  registry as (select loan_id, source_row_number,
    case when issue_month <= '1999-12' then 'train' when issue_month <= '2000-12' then 'validation' else 'test' end as split,
    issue_month, case loan_status when 'Charged Off' then 1 else 0 end as target, 1 as text_available,
    'matured_text_v1' as cohort, 'orders_v1' as dataset_version, marker from reg)"""

BLOCKS_SQL = f"""mc as (select issue_month, count(*) as n from base group by 1),
  ms as (select issue_month, n, (sum(n) over (order by issue_month) - n / 2.0::double) / sum(n) over () as share from mc),
  mb as (select issue_month, n, share, cast(case when share > {SHARE} then least(floor((share - {SHARE}::double) / (1 - {SHARE}::double) * {FOLDS}), {FOLDS - 1}) else -1 end as integer) as block from ms),
  fr as (select block as fold, min(issue_month) as first_month, max(issue_month) as last_month from mb where block >= 0 group by 1),
  folds as (select f.fold, 'fit' as part, b.* from base b join fr f on b.issue_month < f.first_month
    union all select m.block, 'holdout', b.* from base b join mb m using (issue_month) where m.block >= 0)"""
BASE_SQL = "base as (select * from loans where role = 'base_fit')"


def base_rows(spark, sf):
    return views.loans(spark, sf).filter("role = 'base_fit'")


def folds_of(spark, sf):
    return roles.expanding_folds(base_rows(spark, sf), FOLDS, SHARE)


@query("cohort_registry", f"with {COHORT_SQL} select * exclude (marker) from registry", "raw_loans")
def cohort_registry(spark, sf):
    """Eligible rows with id, split, month and outcome."""
    return cohort.registry(views.raw_loans(spark, sf), cohort.SETTINGS)


@query("cohort_diagnostics", f"""with {COHORT_SQL} select (select count(*) from raw_loans) as raw_rows, count(*) as eligible_rows,
  count(*) filter (marker in ('nan', 'none', 'null', 'n/a', 'na', '<na>')) as literal_missing_marker_descriptions from registry""", "raw_loans")
def cohort_diagnostics(spark, sf):
    """Raw rows, eligible rows and literal missing-marker descriptions."""
    return cohort.diagnostics(views.raw_loans(spark, sf), cohort.SETTINGS)


@query("unmapped_splits", f"""with {COHORT_SQL} select split, count(*) as rows, min(issue_month) as first_month, max(issue_month) as last_month
  from registry group by split""", "raw_loans")
def unmapped_splits(spark, sf):
    """Rows and months per assigned split; an unmapped month would show as a NULL split."""
    return cohort.registry(views.raw_loans(spark, sf), cohort.SETTINGS).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("issue_month").alias("first_month"), F.max("issue_month").alias("last_month"))


@query("development_view", f"""with {COHORT_SQL} select split, issue_month, count(*) as rows, cast(sum(target) as bigint) as events
  from registry where split <> 'test' group by all""", "raw_loans")
def development_view(spark, sf):
    """Only unlocked rows leave the registry."""
    view = cohort.development_view(cohort.registry(views.raw_loans(spark, sf), cohort.SETTINGS))
    return view.groupBy("split", "issue_month").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").cast("long").alias("events"))


@query("redacted_statistics", f"""with {COHORT_SQL} select split, count(*) as rows, case when split <> 'test' then cast(sum(target) as bigint) end as events,
  case when split <> 'test' then {s9('avg(target)')} end as event_rate from registry group by split""", "raw_loans")
def redacted_statistics(spark, sf):
    """P5: split statistics with the locked split's label figures removed."""
    return rounded(cohort.split_statistics(cohort.registry(views.raw_loans(spark, sf), cohort.SETTINGS)))


@query("split_targets", "select loan_id, target from loans where split = 'validation'", "loans")
def split_targets(spark, sf):
    """Targets of one unlocked split."""
    return cohort.split_targets(views.loans(spark, sf), "validation")


@query("month_pools", """select 'fit' as pool, count(*) as rows from loans where split = 'train' and issue_month between '1996-01' and '1997-12'
  union all select 'selection', count(*) from loans where split = 'train' and issue_month between '1998-01' and '1998-06'""", "loans")
def month_pools(spark, sf):
    """Month-window pools with their sizes."""
    train = views.loans(spark, sf).filter("split = 'train'")
    pool = roles.split_column(F.col("issue_month"), [("fit", "1996-01", "1997-12"), ("selection", "1998-01", "1998-06")])
    return train.withColumn("pool", pool).filter("pool is not null").groupBy("pool").agg(F.count(F.lit(1)).alias("rows"))


@query("value_counts", "select split, role, purpose, count(*) as rows from loans group by all", "loans")
def value_counts(spark, sf):
    """A1: value counts per split, role and category."""
    return views.loans(spark, sf).groupBy("split", "role", "purpose").agg(F.count(F.lit(1)).alias("rows"))


@query("role_profile", f"""select role, count(*) as rows, cast(sum(target) as bigint) as events, {s9('avg(target)')} as event_rate,
  min(issue_month) as first_month, max(issue_month) as last_month from loans where role is not null group by role""", "loans")
def role_profile(spark, sf):
    """A3, R2: rows, events, event rate and months per role, roles assigned from the ranges table."""
    rows = roles.assign_roles(views.loans(spark, sf).drop("role"), views.ROLE_MONTHS).filter("split <> 'test'")
    return rounded(roles.role_profile(rows))


@query("role_mapping", """select loan_id, split, role, issue_month from loans where role is not null""", "loans")
def role_mapping(spark, sf):
    """One role per unlocked row; the locked split is absent."""
    rows = roles.assign_roles(views.loans(spark, sf).drop("role"), views.ROLE_MONTHS)
    return rows.filter("split <> 'test'").select("loan_id", "split", "role", "issue_month")


@query("role_assignment_checks", """select 'unassigned' as "check", count(*) filter (split <> 'test' and role is null) as violations,
    count(*) filter (split <> 'test' and role is null) = 0 as passed from loans
  union all select 'multiple', count(*), count(*) = 0 from (select loan_id from loans where role is not null group by loan_id having count(*) > 1)
  union all select 'locked_in_role', count(*) filter (split = 'test' and role is not null),
    count(*) filter (split = 'test' and role is not null) = 0 from loans""", "loans")
def role_assignment_checks(spark, sf):
    """Every unlocked row in exactly one role, no locked row in any."""
    from gradeline.operators.checks import row_checks

    rows = roles.assign_roles(views.loans(spark, sf).drop("role"), views.ROLE_MONTHS)
    return row_checks(rows, {
        "unassigned": (F.col("split") != "test") & (F.col("role_count") == 0),
        "multiple": F.col("role_count") > 1,
        "locked_in_role": (F.col("split") == "test") & (F.col("role_count") > 0)})


@query("role_range_checks", """with r as (select role, split, min(issue_month) as a, max(issue_month) as b from loans where role is not null group by all),
  s as (select *, lead(a) over (partition by split order by a) as nxt from r),
  k as (select *, (cast(left(nxt, 4) as int) * 12 + cast(right(nxt, 2) as int)) - (cast(left(b, 4) as int) * 12 + cast(right(b, 2) as int)) as step from s)
  select 'bad_month' as "check", count(*) filter (not regexp_matches(a, '^\\d{4}-(0[1-9]|1[0-2])$')) as violations, count(*) filter (not regexp_matches(a, '^\\d{4}-(0[1-9]|1[0-2])$')) = 0 as passed from k
  union all select 'reversed_range', count(*) filter (a > b), count(*) filter (a > b) = 0 from k
  union all select 'overlap', count(*) filter (step < 1), count(*) filter (step < 1) = 0 from k
  union all select 'gap', count(*) filter (step > 1), count(*) filter (step > 1) = 0 from k""", "loans")
def role_range_checks(spark, sf):
    """The month ranges seen in the data are well formed, ordered and contiguous."""
    seen = views.loans(spark, sf).filter("role is not null").groupBy("role", "split").agg(
        F.min("issue_month").alias("first_month"), F.max("issue_month").alias("last_month"))
    return roles.range_checks(seen)


@query("month_blocks", f"with {BASE_SQL}, {BLOCKS_SQL} select issue_month, n as rows, {s9('share')} as share, block from mb", "loans")
def month_blocks(spark, sf):
    """Month midpoint share and holdout block."""
    return rounded(roles.month_blocks(base_rows(spark, sf), FOLDS, SHARE))


@query("expanding_folds", f"with {BASE_SQL}, {BLOCKS_SQL} select fold, part, loan_id from folds", "loans")
def expanding_folds(spark, sf):
    """Rows of every fold; fit rows are all months before the first holdout month."""
    return folds_of(spark, sf).select("fold", "part", "loan_id")


@query("fold_table", f"""with {BASE_SQL}, {BLOCKS_SQL} select fold, count(*) filter (part = 'fit') as fit_rows,
  count(*) filter (part = 'holdout') as holdout_rows, max(issue_month) filter (part = 'fit') as last_fit_month,
  min(issue_month) filter (part = 'holdout') as first_holdout_month, max(issue_month) filter (part = 'holdout') as last_holdout_month
  from folds group by fold""", "loans")
def fold_table(spark, sf):
    """Fit and holdout rows and months per fold."""
    return roles.fold_table(folds_of(spark, sf))


@query("fold_assignment", f"with {BASE_SQL}, {BLOCKS_SQL} select loan_id, fold from folds where part = 'holdout'", "loans")
def fold_assignment(spark, sf):
    """Fold id per held-out row."""
    return folds_of(spark, sf).filter("part = 'holdout'").select("loan_id", "fold")


@query("fold_checks", f"""with {BASE_SQL}, {BLOCKS_SQL},
  t as (select fold, count(*) filter (part = 'fit') as f, count(*) filter (part = 'holdout') as h, max(issue_month) filter (part = 'fit') as a,
    min(issue_month) filter (part = 'holdout') as b from folds group by fold),
  i as (select loan_id, fold, count(distinct part) as parts, count(*) filter (part = 'holdout') as held from folds group by all),
  v as (select 'empty_folds' as "check", {FOLDS} - count(*) filter (f > 0 and h > 0) as violations from t
    union all select 'fit_not_before_holdout', count(*) filter (a >= b) from t
    union all select 'fit_and_holdout', count(*) filter (parts > 1) from i
    union all select 'held_out_twice', count(*) from (select loan_id from i group by 1 having sum(held) > 1))
  select *, violations = 0 as passed from v""", "loans")
def fold_checks(spark, sf):
    """No fold fits on its own or later months, holdouts are disjoint."""
    return roles.fold_checks(folds_of(spark, sf), FOLDS)


@query("fitting_only_rows", f"""with {BASE_SQL}, {BLOCKS_SQL},
  x as (select b.issue_month, b.loan_id in (select loan_id from folds where part = 'holdout') as scored from base b)
  select count(*) filter (scored) as scored_rows, count(*) filter (not scored) as fitting_only_rows,
    min(issue_month) filter (not scored) as first_fitting_only_month, max(issue_month) filter (not scored) as last_fitting_only_month from x""", "loans")
def fitting_only_rows(spark, sf):
    """Scored rows against fitting-only rows."""
    rows = base_rows(spark, sf)
    held = roles.expanding_folds(rows, FOLDS, SHARE).filter("part = 'holdout'").select("loan_id")
    only = rows.join(held, "loan_id", "left_anti").agg(
        F.count(F.lit(1)).alias("fitting_only_rows"), F.min("issue_month").alias("first_fitting_only_month"),
        F.max("issue_month").alias("last_fitting_only_month"))
    return held.agg(F.count(F.lit(1)).alias("scored_rows")).join(only)


U = "('0x' || substr(md5(concat_ws('|', '{salt}', cast({key} as varchar))), 1, 8))::bigint / 4294967296.0::double"


@query("hash_uniform", f"select loan_id, {U.format(salt='draw-7', key='loan_id')} as u from loans", "loans")
def hash_uniform(spark, sf):
    """the seeded draw itself, equal bit for bit."""
    from gradeline.functions.sampling import hash_uniform as draw

    return views.loans(spark, sf).select("loan_id", draw(F.col("loan_id"), "draw-7").alias("u"))


D = "('0x' || substr(md5(concat_ws('|', '{salt}', cast({key} as varchar))), 1, 15))::bigint"


@query("stratified_folds", f"""with {BASE_SQL}, d as (select *, {D.format(salt='kfold-42', key='loan_id')} as u from base),
  r as (select loan_id, target, row_number() over (partition by target order by u) as k, count(*) over (partition by target) as n from d)
  select loan_id, target, cast((k > (n + 4) // 5)::int + (k > (2 * n + 4) // 5)::int + (k > (3 * n + 4) // 5)::int + (k > (4 * n + 4) // 5)::int as integer) as fold from r""", "loans")
def stratified_folds(spark, sf):
    """Shuffled stratified k-fold over seeded draws."""
    return roles.stratified_folds(base_rows(spark, sf), "loan_id", 5, "kfold-42").select("loan_id", "target", "fold")


@query("stratified_sample", f"""with d as (select *, {D.format(salt='sample-42', key='loan_id')} as u from loans where split = 'train'),
  c as (select target, count(*) as n, 500.0::double * count(*) / sum(count(*)) over () as x from d group by target),
  q as (select target, floor(x) + case when row_number() over (order by x - floor(x) desc, target) <= 500 - sum(floor(x)) over () then 1 else 0 end as quota from c)
  select loan_id, target from (select *, row_number() over (partition by target order by u, loan_id) as k from d) join q using (target) where k <= quota""", "loans")
def stratified_sample(spark, sf):
    """An exact-size stratified sample."""
    return roles.stratified_sample(views.loans(spark, sf).filter("split = 'train'"), "loan_id", 500, "sample-42").select("loan_id", "target")


@query("class_weights", f"""with t as (select * from loans where split = 'train'), s as (select count(*) as n, sum(target) as p from t)
  select target, count(*) as rows, {s9('max(n) / (2.0::double * count(*))')} as balanced_weight,
    {s9('case when target = 1 then (max(n) - max(p))::double / max(p)::double else 1 end')} as loss_weight from t, s group by target""", "loans")
def class_weights(spark, sf):
    """Balanced class weights and the positive-class loss weight."""
    return rounded(roles.class_weights(views.loans(spark, sf).filter("split = 'train'")))


@query("year_buckets", """select case when left(issue_month, 4) >= '1997' then left(issue_month, 4) else '1995-1996' end as bucket,
  count(*) as rows from loans group by 1""", "loans")
def year_buckets(spark, sf):
    """F16: year buckets with the early years merged."""
    bucket = C.year_bucket(F.col("issue_month"), "1997", "1995-1996")
    return views.loans(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


