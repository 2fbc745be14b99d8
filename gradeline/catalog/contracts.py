"""Contract checks, key joins, set comparisons and fusion tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline import views
from gradeline.catalog.base import query, r9, s9
from gradeline.catalog.cohort import COHORT_SQL
from gradeline.functions import columns as C
from gradeline.operators import checks, fusion, joins
from gradeline.plans import cohort


def open_loans(spark, sf):
    return views.loans(spark, sf).filter("split <> 'test'")


def scoring_rows(spark, sf):
    return views.loans(spark, sf).filter(F.col("role").isin(*views.SCORING_ROLES))


def mapping(spark, sf):
    return scoring_rows(spark, sf).select("loan_id", "split", "role")


def tabular_scores(spark, sf):
    return fusion.prediction_table(scoring_rows(spark, sf), F.col("p_a"), "logistic_regression", "tabular-v1")


def text_export(spark, sf, version="text-v2"):
    """A six-column export whose margin is the logit of its probability."""
    return scoring_rows(spark, sf).select(
        "loan_id", "split", "role", C.logit(F.col("p_b")).alias("raw_margin"), F.col("p_b").alias("raw_prob"),
        F.lit(version).alias("model_version"))


def orders(spark, sf):
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_totalprice")


def line_keys(spark, sf):
    return views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))


def flags(names: list[str], source: str) -> str:
    """Check rows from a one-row CTE with one violation count per name."""
    return " union all ".join(f"select '{n}' as \"check\", cast({n} as bigint) as violations, {n} = 0 as passed from {source}" for n in names)


@query("registry_checks", f"""with {COHORT_SQL}, v as (select count(*) filter (not regexp_matches(loan_id, '^lc_\\d{{9}}$')) as bad_identifier,
    count(*) filter (source_row_number < 1) as bad_row_number, count(*) filter (cast(right(loan_id, 9) as bigint) <> source_row_number) as identifier_row_mismatch,
    count(*) filter (split not in ('train', 'validation', 'test')) as unknown_split, count(*) filter (text_available not in (0, 1)) as bad_text_flag,
    count(*) filter (split <> 'test' and target not in (0, 1)) as bad_target, count(*) filter (cohort <> 'matured_text_v1') as wrong_cohort,
    count(*) filter (dataset_version <> 'orders_v1') as wrong_dataset_version, count(*) - count(distinct loan_id) as unique_loan_id,
    count(*) - count(distinct source_row_number) as unique_source_row_number,
    count(*) filter (split = 'train') - count(*) filter (issue_month <= '1999-12') as rows_train,
    count(*) filter (split = 'validation') - count(*) filter (issue_month between '2000-01' and '2000-12') as rows_validation,
    count(*) filter (split = 'test') - count(*) filter (issue_month > '2000-12') as rows_test from registry)
  {flags(['bad_identifier', 'bad_row_number', 'identifier_row_mismatch', 'unknown_split', 'bad_text_flag', 'bad_target', 'wrong_cohort',
          'wrong_dataset_version', 'unique_loan_id', 'unique_source_row_number', 'rows_train', 'rows_validation', 'rows_test'], 'v')}""", "raw_loans")
def registry_checks(spark, sf):
    """Row rules, unique keys and recorded counts of the registry."""
    table = cohort.registry(views.raw_loans(spark, sf), cohort.SETTINGS)
    recorded = table.groupBy("split").agg(F.count(F.lit(1)).alias("expected_rows"))
    return cohort.registry_checks(table, recorded, cohort.SETTINGS)


@query("registry_audit", f"""with {COHORT_SQL}, locked as (select loan_id, split, issue_month, target from loans),
  v as (select (select count(*) from locked anti join registry using (loan_id)) as missing, (select count(*) from registry anti join locked using (loan_id)) as extra,
    (select count(*) - count(distinct loan_id) from registry) as duplicates, (select count(*) from registry r join locked l using (loan_id) where r.split is distinct from l.split) as mismatch_split,
    (select count(*) from registry r join locked l using (loan_id) where r.issue_month is distinct from l.issue_month) as mismatch_issue_month,
    (select count(*) from registry r join locked l using (loan_id) where r.target is distinct from l.target) as mismatch_target,
    (select count(*) from (select split, count(*) as n from registry group by 1) a full join (select split, count(*) as n from locked group by 1) b using (split)
      where a.n is distinct from b.n) as split_counts)
  {flags(['missing', 'extra', 'duplicates', 'mismatch_split', 'mismatch_issue_month', 'mismatch_target', 'split_counts'], 'v')}""", "raw_loans loans")
def registry_audit(spark, sf):
    """The rebuilt registry against a locked one (blank descriptions are not eligible, so ids differ)."""
    rebuilt = cohort.registry(views.raw_loans(spark, sf), cohort.SETTINGS).select("loan_id", "split", "issue_month", "target")
    return cohort.audit(rebuilt, views.loans(spark, sf).select("loan_id", "split", "issue_month", "target"))


@query("registry_mismatches", f"""with {COHORT_SQL}, b as (select r.*, l.split as s2, l.target as t2, l.issue_month as m2 from registry r join loans l using (loan_id))
  select 'split' as "column", count(*) filter (split is distinct from s2) as mismatches from b
  union all select 'target', count(*) filter (target is distinct from t2) from b
  union all select 'issue_month', count(*) filter (issue_month is distinct from m2) from b""", "raw_loans loans")
def registry_mismatches(spark, sf):
    """Null-safe mismatch counts per column over the shared ids."""
    rebuilt = cohort.registry(views.raw_loans(spark, sf), cohort.SETTINGS)
    return joins.mismatches(rebuilt, views.loans(spark, sf), "loan_id", ["split", "target", "issue_month"])


@query("source_alignment", """with j as (select l.*, r.issue_d, r.loan_status from loans l left join raw_loans r using (source_row_number))
  select 'unmatched_rows' as "check", count(*) filter (issue_d is null) as violations, count(*) filter (issue_d is null) = 0 as passed from j
  union all select 'month_disagrees', count(*) filter (strftime(strptime(issue_d, '%b-%Y'), '%Y-%m') <> issue_month), count(*) filter (strftime(strptime(issue_d, '%b-%Y'), '%Y-%m') <> issue_month) = 0 from j
  union all select 'outcome_disagrees', count(*) filter ((loan_status = 'Charged Off')::int <> target), count(*) filter ((loan_status = 'Charged Off')::int <> target) = 0 from j""", "loans raw_loans")
def source_alignment(spark, sf):
    """Registry rows against their source records, month and outcome cross-checked."""
    raw = views.raw_loans(spark, sf).select("source_row_number", "issue_d", "loan_status")
    joined = joins.left_join(views.loans(spark, sf), raw, "source_row_number")
    observed = F.when(F.col("loan_status") == "Charged Off", 1).when(F.col("loan_status") == "Fully Paid", 0)
    return checks.row_checks(joined, {
        "unmatched_rows": ~F.col("_matched"),
        "month_disagrees": F.col("_matched") & ~C.month_label(C.parse_month(F.col("issue_d"))).eqNullSafe(F.col("issue_month")),
        "outcome_disagrees": F.col("_matched") & ~observed.eqNullSafe(F.col("target"))})


@query("join_contract", """with o as (select o_orderkey as key from orders), l as (select l_orderkey as key, count(*) as n from lineitem group by 1),
  v as (select (select count(*) - count(distinct key) from o) as repeated_base_keys, (select sum(n - 1) from l) as repeated_other_keys,
    (select count(*) from o anti join l using (key)) as unmatched_base_rows, (select count(*) from l anti join o using (key)) as unused_other_rows)
  """ + flags(["repeated_base_keys", "repeated_other_keys", "unmatched_base_rows", "unused_other_rows"], "v"))
def join_contract(spark, sf):
    """Cardinality and match counts of a join that is not one-to-one."""
    return joins.join_checks(orders(spark, sf), line_keys(spark, sf), "key")


@query("key_coverage", """with o as (select o_orderkey as key from orders), l as (select l_orderkey as key, count(*) as n from lineitem group by 1),
  v as (select (select count(*) from o anti join l using (key)) as missing, (select count(*) from l anti join o using (key)) as extra, (select sum(n - 1) from l) as duplicates)
  """ + flags(["missing", "extra", "duplicates"], "v"))
def key_coverage(spark, sf):
    """Exact two-sided coverage of a key set."""
    return checks.coverage_checks(line_keys(spark, sf), orders(spark, sf), ["key"])


@query("key_quality", """select 'o_orderkey' as "column", count(*) filter (o_orderkey is null) as missing, count(distinct o_orderkey) as distinct_values,
    count(o_orderkey) - count(distinct o_orderkey) as repeats from orders
  union all select 'o_custkey', count(*) filter (o_custkey is null), count(distinct o_custkey), count(o_custkey) - count(distinct o_custkey) from orders""")
def key_quality(spark, sf):
    """Missing, distinct and repeated key values."""
    return checks.key_quality(views.table(spark, sf, "orders"), ["o_orderkey", "o_custkey"])


@query("semi_join", "select loan_id, role from loans where purpose in (select c_mktsegment from customer where c_acctbal > 9000) and role = 'validation'", "loans")
def semi_join(spark, sf):
    """Keep only wanted keys."""
    wanted = views.table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_mktsegment").alias("purpose"))
    return joins.ids_in(views.loans(spark, sf).filter("role = 'validation'"), wanted, "purpose").select("loan_id", "role")


@query("anti_join", "select o_orderkey as key from orders where o_orderkey not in (select l_orderkey from lineitem)")
def anti_join(spark, sf):
    """Rows the other table never saw."""
    return joins.ids_not_in(orders(spark, sf), line_keys(spark, sf), "key").select("key")


@query("locked_ids", """select 'locked_ids_in_roles' as "check", count(*) as violations, count(*) = 0 as passed from loans where role is not null and split = 'test'""", "loans")
def locked_ids(spark, sf):
    """No locked id among the mapped ids."""
    rows = views.loans(spark, sf)
    leaked = joins.ids_in(rows.filter("role is not null").select("loan_id"), rows.filter("split = 'test'"))
    return checks.check_rows(leaked.agg(F.count(F.lit(1)).alias("locked_ids_in_roles")), ["locked_ids_in_roles"])


@query("model_id_leak", """with m as (select loan_id from loans where split = 'train' and p_a < 0.3),
  v as (select count(*) as scored_rows_seen_by_model from loans where role in ('fusion_fit', 'fusion_calibration', 'validation') and loan_id in (select loan_id from m))
  """ + flags(["scored_rows_seen_by_model"], "v"), "loans")
def model_id_leak(spark, sf):
    """Scored ids that the scoring model was trained or selected on (natural violations here)."""
    model_ids = views.loans(spark, sf).filter("split = 'train' and p_a < 0.3")
    seen = joins.ids_in(scoring_rows(spark, sf), model_ids)
    return checks.check_rows(seen.agg(F.count(F.lit(1)).alias("scored_rows_seen_by_model")), ["scored_rows_seen_by_model"])


@query("role_id_scope", """with v as (select count(*) filter (split <> 'train' or role <> 'base_fit') as ids_outside_role,
    abs(count(*) - (select count(*) from loans where split = 'train' and issue_month <= '1998-12')) as count_difference from loans where role = 'base_fit') """ + flags(["ids_outside_role", "count_difference"], "v"), "loans")
def role_id_scope(spark, sf):
    """Score ids lie inside one role and match the recorded count."""
    role_ids = views.loans(spark, sf).filter("role = 'base_fit'")
    scored = role_ids.select("loan_id", "p_a")
    outside = joins.ids_not_in(scored, role_ids).agg(F.count(F.lit(1)).alias("ids_outside_role"))
    difference = scored.agg(F.count(F.lit(1)).alias("_n")).join(role_ids.agg(F.count(F.lit(1)).alias("_m"))).select(
        F.abs(F.col("_n") - F.col("_m")).alias("count_difference"))
    return checks.check_rows(outside, ["ids_outside_role"]).unionByName(checks.check_rows(difference, ["count_difference"]))


@query("outer_agreement", """with a as (select loan_id, split, role from loans where split <> 'test'), b as (select loan_id, split, case when role = 'validation' then role else 'train' end as role from loans where role <> 'fusion_fit')
  select count(*) filter (b.loan_id is null) as left_only, count(*) filter (a.loan_id is null) as right_only,
    count(*) filter (a.loan_id is not null and b.loan_id is not null and (a.split <> b.split or a.role <> b.role)) as disagreeing
  from a full join b using (loan_id)""", "loans")
def outer_agreement(spark, sf):
    """Two-sided coverage and agreement of two mappings."""
    left = open_loans(spark, sf).select("loan_id", "split", "role")
    right = views.loans(spark, sf).filter("role <> 'fusion_fit'").withColumn(
        "role", F.when(F.col("role") == "validation", F.col("role")).otherwise("train"))
    return joins.outer_agreement(left, right, "loan_id", ["split", "role"])


@query("attach_roles", """select loan_id, issue_month, split, role from loans where split <> 'test'""", "loans")
def attach_roles(spark, sf):
    """Rows with the role of the published mapping."""
    rows = open_loans(spark, sf)
    joined, bad = joins.attach_roles(rows.select("loan_id", "issue_month", "split"), rows.select("loan_id", "split", "role"))
    checks.enforce(bad, "role mapping")
    return joined.select("loan_id", "issue_month", "split", "role")


@query("align_to_ids", """select loan_id, split, row_number() over (order by split, loan_id) as position, p_a from loans where split <> 'test'""", "loans")
def align_to_ids(spark, sf):
    """Features on an expected (id, split) list, ordered by its own position column."""
    rows = open_loans(spark, sf)
    expected = joins_position(rows)
    aligned, bad = joins.align(expected, rows.select("loan_id", "split", "p_a"))
    checks.enforce(bad, "frozen ids")
    return aligned.select("loan_id", "split", "position", "p_a")


def joins_position(rows):
    from gradeline.operators.ordering import global_rank

    return global_rank(rows.select("split", "loan_id"), ["split", "loan_id"]).withColumnRenamed("rank", "position")


@query("split_checked_join", """with d as (select loan_id, case when purpose = 'BUILDING' then 'train' else split end as split, annual_inc / 10000.0::double as density from loans),
  j as (select l.loan_id, l.split, d.split as s2, d.density from loans l left join d using (loan_id) where l.split <> 'test'),
  v as (select count(*) filter (split <> s2) as split_disagrees, count(*) filter (not (density between 0 and 1)) as outside_unit_interval from j)
  """ + flags(["split_disagrees", "outside_unit_interval"], "v"), "loans")
def split_checked_join(spark, sf):
    """Feature join that requires split equality and a value range."""
    density = views.loans(spark, sf).select(
        "loan_id", F.when(F.col("purpose") == "BUILDING", "train").otherwise(F.col("split")).alias("_split"),
        (F.col("annual_inc") / F.lit(10000.0)).alias("density"))
    joined = open_loans(spark, sf).join(density, "loan_id", "left")
    return checks.row_checks(joined, {
        "split_disagrees": ~F.col("split").eqNullSafe(F.col("_split")),
        "outside_unit_interval": ~C.is_probability(F.col("density"))})


@query("label_join", "select loan_id, role, target, p_a from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')", "loans")
def label_join(spark, sf):
    """Outcomes attached by id for every role in one pass; a missing label raises."""
    labels = open_loans(spark, sf).select("loan_id", "target")
    scores = scoring_rows(spark, sf).select("loan_id", "role", "p_a")
    return joins.checked_join(scores, labels, name="labels").select("loan_id", "role", "target", "p_a")


@query("reference_alignment", """with v as (select count(*) filter (abs(p_a - (case when p_a > 0.8 then p_a + 1e-6::double else p_a end)) > 1e-12) as reference_differs
  from loans where role = 'validation') """ + flags(["reference_differs"], "v"), "loans")
def reference_alignment(spark, sf):
    """The reference score equals the track score within 1e-12, joined by key."""
    rows = views.loans(spark, sf).filter("role = 'validation'")
    reference = rows.select("loan_id", F.when(F.col("p_a") > 0.8, F.col("p_a") + F.lit(1e-6)).otherwise(F.col("p_a")).alias("p_reference"))
    joined = rows.select("loan_id", "p_a").join(reference, "loan_id", "left")
    return checks.row_checks(joined, {"reference_differs": C.differs(F.col("p_reference"), F.col("p_a"), 1e-12)})


@query("tolerance", """select purpose, count(*) filter (abs(p_a - p_b) > 0.1::double + 0.05::double * abs(p_b)) as outside, count(*) as rows from loans group by purpose""", "loans")
def tolerance(spark, sf):
    """values outside atol + rtol * |b|."""
    return views.loans(spark, sf).groupBy("purpose").agg(
        F.count_if(C.differs(F.col("p_a"), F.col("p_b"), 0.1, 0.05)).alias("outside"), F.count(F.lit(1)).alias("rows"))


@query("published_confusion", """with k as (select count(*) filter (p_a < 0.5 and target = 0) as tn, count(*) filter (p_a >= 0.5 and target = 0) as fp,
    count(*) filter (p_a < 0.5 and target = 1) as fn, count(*) filter (p_a >= 0.5 and target = 1) as tp from loans where role = 'validation')
  select unnest(['tn', 'fp', 'fn', 'tp']) as cell, unnest([tn, fp, fn, tp]) as observed, unnest([tn, fp, fn, tp]) as published, true as passed from k""", "loans")
def published_confusion(spark, sf):
    """Labels joined by id must reproduce a published confusion matrix."""
    from gradeline.operators.scoring import confusion

    rows = views.loans(spark, sf).filter("role = 'validation'")
    joined = rows.select("loan_id", "p_a").join(rows.select("loan_id", "target"), "loan_id")
    cells = ["tn", "fp", "fn", "tp"]
    count = lambda df, name: df.agg(*confusion(F.col("p_a"), F.col("target"), 0.5)).unpivot([], cells, "cell", name)
    return count(joined, "observed").join(count(rows, "published"), "cell").withColumn("passed", F.col("observed") == F.col("published"))


@query("expected_ids", """select 'calibration' as "set", loan_id, target from loans where role in ('fusion_fit', 'fusion_calibration')
  union all select 'validation', loan_id, target from loans where split = 'validation'""", "loans")
def expected_ids(spark, sf):
    """Expected ids per scoring set, from roles and the registry, with outcomes."""
    return fusion.expected_ids(views.loans(spark, sf), {"calibration": ["fusion_fit", "fusion_calibration"], "validation": ["validation"]})


@query("union_files", """select loan_id, p_a as p_default_tabular, 'tabular-v1' as tabular_model_version from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')""", "loans")
def union_files(spark, sf):
    """Files of one track unioned, overlap refused, exact coverage of the scored ids."""
    scores = tabular_scores(spark, sf)
    parts = [scores.filter("split = 'train'"), scores.filter("split = 'validation'")]
    return fusion.union_track(parts, mapping(spark, sf), "tabular")


@query("source_set_checks", """with s as (select 'tabular' as source, loan_id, split, p_a as p, 'logistic_regression' as n from loans where role is not null
    union all select 'text', loan_id, split, p_b, case when p_b > 0.9 then 'other' else 'tfidf' end from loans where role is not null),
  v as (select source, count(*) filter (p is null or not (p between 0 and 1)) as invalid_probability, count(*) filter (split not in ('train', 'validation')) as wrong_split,
    count(*) filter (n <> case source when 'tabular' then 'logistic_regression' else 'tfidf' end) as wrong_model_name from s group by source)
  select source, unnest(['invalid_probability', 'wrong_split', 'wrong_model_name']) as "check", unnest([invalid_probability, wrong_split, wrong_model_name]) as violations,
    unnest([invalid_probability = 0, wrong_split = 0, wrong_model_name = 0]) as passed from v""", "loans")
def source_set_checks(spark, sf):
    """Every pinned source checked in one aggregation, the failing one named."""
    rows = open_loans(spark, sf)
    tabular = fusion.prediction_table(rows, F.col("p_a"), "logistic_regression", "v1").withColumn("source", F.lit("tabular"))
    text = fusion.prediction_table(rows, F.col("p_b"), "tfidf", "v1").withColumn("source", F.lit("text")).withColumn(
        "model_name", F.when(F.col("p_default_tabular") > 0.9, "other").otherwise(F.col("model_name")))
    expected = F.when(F.col("source") == "tabular", "logistic_regression").otherwise("tfidf")
    return checks.row_checks(tabular.unionByName(text), {
        "invalid_probability": ~C.is_probability(F.col("p_default_tabular")),
        "wrong_split": ~F.col("split").isin("train", "validation"), "wrong_model_name": F.col("model_name") != expected}, ["source"])


@query("prediction_table", """select loan_id, split, p_a as p_default_tabular, 'logistic_regression' as model_name, 'tabular-v1' as model_version
  from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')""", "loans")
def prediction_table(spark, sf):
    """The flat prediction table."""
    return tabular_scores(spark, sf)


@query("prediction_checks", """with e as (select loan_id from loans where role is not null), f as (select loan_id, p_a as p from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')),
  v as (select (select count(*) from e anti join f using (loan_id)) as missing, (select count(*) from f anti join e using (loan_id)) as extra, count(*) - count(distinct loan_id) as duplicates,
    count(*) filter (p is null) as null_probability, count(*) filter (p is not null and not (p between 0 and 1)) as outside_unit_interval from f) """ + flags(["missing", "extra", "duplicates", "null_probability", "outside_unit_interval"], "v"), "loans")
def prediction_checks(spark, sf):
    """The prediction contract against every mapped id (base rows are not scored, so they are missing)."""
    return checks.prediction_checks(tabular_scores(spark, sf), open_loans(spark, sf))


@query("score_export", f"""select loan_id, split, role, {s9('ln(p_b / (1 - p_b))')} as raw_margin, p_b as raw_prob, 'text-v2' as model_version
  from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')""", "loans")
def score_export(spark, sf):
    """Margin and probability of one model."""
    return text_export(spark, sf).withColumn("raw_margin", r9("raw_margin"))


@query("export_checks", """with e as (select loan_id, split as s0, role as r0 from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')),
  f as (select loan_id, split, role, ln(p_b / (1 - p_b)) as margin, p_b as p, 'text-v2' as model_version from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')),
  v as (select (select count(*) from e anti join f using (loan_id)) as missing, (select count(*) from f anti join e using (loan_id)) as extra, count(*) - count(distinct loan_id) as duplicates,
    count(*) filter (split is distinct from s0) as split_disagrees, count(*) filter (role is distinct from r0) as role_disagrees, count(*) filter (not isfinite(margin)) as margin_not_finite,
    count(*) filter (p is null or not (p between 0 and 1)) as probability_invalid, count(*) filter (abs(p - 1 / (1 + exp(-margin))) > 1e-9) as not_sigmoid_of_margin,
    count(*) filter (model_version <> 'text-v3') as wrong_version from f left join e using (loan_id))
  """ + flags(["missing", "extra", "duplicates", "split_disagrees", "role_disagrees", "margin_not_finite", "probability_invalid", "not_sigmoid_of_margin", "wrong_version"], "v"), "loans")
def export_checks(spark, sf):
    """The six-column contract, with a version pin that does not match."""
    return checks.export_checks(text_export(spark, sf), mapping(spark, sf), "text-v3")


@query("recorded_counts", """select role, count(*) as rows, case when role = 'validation' then count(*) + 1 else count(*) end as expected_rows, role <> 'validation' as passed
  from loans where role is not null group by role""", "loans")
def recorded_counts(spark, sf):
    """K6: rows per role against the recorded ones, one record off."""
    rows = open_loans(spark, sf)
    recorded = rows.groupBy("role").agg(F.count(F.lit(1)).alias("_n")).select(
        "role", (F.col("_n") + F.when(F.col("role") == "validation", 1).otherwise(0)).alias("expected_rows"))
    return checks.count_checks(rows, "role", recorded)


@query("binary_target", """with v as (select count(*) filter (quality not in (0, 1)) as target_not_binary, 2 - count(distinct quality) as classes_missing from labels)
  """ + flags(["target_not_binary", "classes_missing"], "v"))
def binary_target(spark, sf):
    """K7: binary target with both classes."""
    return checks.binary_target_checks(views.table(spark, sf, "labels"), "quality")


@query("disjoint_sets", """with s as (select 'fit' as l, o_custkey as id from orders where o_orderstatus = 'F' group by all union all select 'open', o_custkey from orders where o_orderstatus = 'O' group by all
    union all select 'partial', o_custkey from orders where o_orderstatus = 'P' group by all)
  select a.l as left_set, b.l as right_set, count(*) as shared from s a join s b on a.id = b.id and a.l < b.l group by all""")
def disjoint_sets(spark, sf):
    """Ids shared by each pair of sets."""
    rows = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    named = {"fit": "F", "open": "O", "partial": "P"}
    return checks.disjointness({n: rows.filter(F.col("o_orderstatus") == s) for n, s in named.items()}, "id")


@query("one_value", """with s as (select 'logistic' as model_name, case when p_a > 0.5 then 'v1' else 'v2' end as model_version from loans)
  select 'model_name' as "column", count(distinct model_name) as distinct_values, 0 as blank_rows, min(model_name) as first_value, count(distinct model_name) = 1 as passed from s
  union all select 'model_version', count(distinct model_version), 0, min(model_version), count(distinct model_version) = 1 from s""", "loans")
def one_value(spark, sf):
    """U4: one model name and version per score table."""
    rows = views.loans(spark, sf).select(F.lit("logistic").alias("model_name"), F.when(F.col("p_a") > 0.5, "v1").otherwise("v2").alias("model_version"))
    return checks.one_value(rows, ["model_name", "model_version"])


@query("tables_agree", """with a as (select loan_id, p_a from loans where role is not null), b as (select loan_id, p_a from loans where role <> 'base_fit' union all select loan_id, p_b from loans where role = 'base_fit')
  select (select count(*) from (select * from a except all select * from b)) as left_only, (select count(*) from (select * from b except all select * from a)) as right_only""", "loans")
def tables_agree(spark, sf):
    """Exact agreement of two tables on their shared columns."""
    rows = open_loans(spark, sf)
    other = rows.select("loan_id", F.when(F.col("role") == "base_fit", F.col("p_b")).otherwise(F.col("p_a")).alias("p_a"))
    return checks.tables_agree(rows, other, ["loan_id", "p_a"])


@query("offending_examples", "select loan_id, annual_inc from loans where annual_inc < 0 order by loan_id limit 3", "loans")
def offending_examples(spark, sf):
    """The first three offending rows by id."""
    return checks.examples(views.loans(spark, sf), F.col("annual_inc") < 0, "loan_id", ["annual_inc"])


@query("score_join", """select loan_id, split, role, p_a as p_default_tabular, 'tabular-v1' as tabular_model_version, p_b as p_default_text, 'text-v2' as text_model_version
  from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')""", "loans")
def score_join(spark, sf):
    """Every track joined onto the role mapping, role as a column."""
    tracks = {"tabular": fusion.tabular_track(tabular_scores(spark, sf)), "text": fusion.export_track(text_export(spark, sf), "text")}
    return fusion.fusion_table(mapping(spark, sf), tracks)


@query("fusion_fold_table", """select loan_id, split, role, p_a as p_default_tabular, p_b as p_default_text, cast(length(purpose) % 3 as integer) as fold_id
  from loans where role in ('fusion_fit', 'fusion_calibration')""", "loans")
def fusion_fold_table(spark, sf):
    """Y2: the fit-side fusion table with its fold ids."""
    rows = scoring_rows(spark, sf).filter("split = 'train'")
    tracks = {"tabular": rows.select("loan_id", F.col("p_a").alias("p_default_tabular"), F.pmod(F.length("purpose"), F.lit(3)).alias("fold_id")),
              "text": rows.select("loan_id", F.col("p_b").alias("p_default_text"))}
    return joins.join_scores(rows.select("loan_id", "split", "role"), tracks).select(
        "loan_id", "split", "role", "p_default_tabular", "p_default_text", "fold_id")


@query("fusion_table_checks", """with e as (select loan_id, split, role from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')),
  a as (select loan_id, p_a, 'tabular-v1' as va from loans where split <> 'test'), b as (select loan_id, p_b, 'text-v2' as vb from loans where split <> 'test'),
  f as (select e.*, p_a, va, p_b, vb from e left join a using (loan_id) left join b using (loan_id)),
  v as (select (select count(*) from e anti join f using (loan_id)) as missing, (select count(*) from f anti join e using (loan_id)) as extra, count(*) - count(distinct loan_id) as duplicates,
    count(*) filter (p_a is null or not (p_a between 0 and 1)) as invalid_tabular, count(*) filter (p_b is null or not (p_b between 0 and 1)) as invalid_text,
    count(*) filter (va is distinct from 'tabular-v1') as wrong_tabular_version, count(*) filter (vb is distinct from 'text-v2') as wrong_text_version,
    count(*) filter (split <> case when role = 'validation' then 'validation' else 'train' end) as labels_disagree from f) """ + flags(["missing", "extra", "duplicates", "invalid_tabular", "invalid_text", "wrong_tabular_version", "wrong_text_version", "labels_disagree"], "v"), "loans")
def fusion_table_checks(spark, sf):
    """The hand-off table has no outcome column, exact ids, labels, ranges and pinned versions."""
    table = score_join(spark, sf)
    return fusion.fusion_checks(table, mapping(spark, sf), {"tabular": "tabular-v1", "text": "text-v2"})


@query("track_metadata", """select loan_id, p_default_tabular, tabular_model_name, tabular_model_version from (select loan_id, p_a as p_default_tabular, 'logistic_regression' as tabular_model_name,
  'tabular-v1' as tabular_model_version from loans where role in ('fusion_fit', 'fusion_calibration', 'validation'))""", "loans")
def track_metadata(spark, sf):
    """P10: metadata columns prefixed per track before a multi-way join."""
    return joins.with_track_prefix(tabular_scores(spark, sf), "tabular").select(
        "loan_id", "p_default_tabular", "tabular_model_name", "tabular_model_version")


@query("calibrated_frame_checks", """with e as (select loan_id from loans where issue_month between '2000-01' and '2000-12'),
  f as (select loan_id, split, p_a as raw, 1 / (1 + exp(-(0.8::double * ln(p_a / (1 - p_a)) - 0.1::double))) as cal from loans where role = 'validation'),
  v as (select (select count(*) from e anti join f using (loan_id)) as missing, (select count(*) from f anti join e using (loan_id)) as extra, count(*) - count(distinct loan_id) as duplicates,
    count(*) filter (raw is null or not (raw between 0 and 1)) as invalid_raw, count(*) filter (cal is null or not (cal between 0 and 1)) as invalid_calibrated,
    count(*) filter (split <> 'validation') as wrong_split from f)
  """ + flags(["missing", "extra", "duplicates", "invalid_raw", "invalid_calibrated", "wrong_split"], "v"), "loans")
def calibrated_frame_checks(spark, sf):
    """The calibrated-score table, one check per probability column."""
    rows = views.loans(spark, sf).filter("role = 'validation'")
    frame = rows.select("loan_id", "split", F.col("p_a").alias("raw"), C.platt(F.col("p_a"), 0.8, -0.1, 1e-6).alias("calibrated"))
    return checks.coverage_checks(frame, rows, ["loan_id"]).unionByName(checks.row_checks(frame, {
        "invalid_raw": ~C.is_probability(F.col("raw")), "invalid_calibrated": ~C.is_probability(F.col("calibrated")),
        "wrong_split": F.col("split") != "validation"}))


@query("count_by_version", "select model_version, count(*) as rows from (select case when p_a > 0.5 then 'v1' else 'v2' end as model_version from loans where role is not null) group by 1", "loans")
def count_by_version(spark, sf):
    """Version counts of one written table."""
    rows = open_loans(spark, sf).select(F.when(F.col("p_a") > 0.5, "v1").otherwise("v2").alias("model_version"))
    return rows.groupBy("model_version").agg(F.count(F.lit(1)).alias("rows"))


