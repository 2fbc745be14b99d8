"""Tabular feature, scalar-function and nested-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline import views
from gradeline.catalog.base import query, r9, rounded, s9
from gradeline.functions import columns as C
from gradeline.operators import checks
from gradeline.plans import features as P

NUM = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)$"

FEATURES_SQL = """f as (select l.loan_id, l.split, l.role, l.issue_month, l.target, try_cast(nullif(trim(r.loan_amnt), '') as double) as loan_amnt,
    case when try_cast(r.annual_inc as double) >= 0 then ln(1 + try_cast(r.annual_inc as double)) end as annual_inc_log,
    try_cast(r.dti as double) as dti, try_cast(nullif(trim(r.revol_util), '') as double) as revol_util, try_cast(r.delinq_2yrs as double) as delinq_2yrs,
    try_cast(r.inq_last_6mths as double) as inq_last_6mths,
    cast((year(strptime(r.issue_d, '%b-%Y')) - year(strptime(r.earliest_cr_line, '%b-%Y'))) * 12 + month(strptime(r.issue_d, '%b-%Y')) - month(strptime(r.earliest_cr_line, '%b-%Y')) as double) as credit_history_months,
    nullif(regexp_extract(trim(r.term), '^(\\d+) months$', 1), '') as term,
    case when upper(trim(r.home_ownership)) in ('NONE', 'OTHER', 'ANY') then 'OTHER' else upper(trim(r.home_ownership)) end as home_ownership
  from loans l left join raw_loans r using (source_row_number) where l.split <> 'test')"""


def registry(spark, sf):
    return views.loans(spark, sf).filter("split <> 'test'")


def feature_rows(spark, sf):
    return P.build(views.raw_loans(spark, sf), registry(spark, sf))


@query("feature_table", f"""with {FEATURES_SQL} select loan_id, split, role, issue_month, target, loan_amnt, {s9('annual_inc_log')} as annual_inc_log, dti, revol_util,
  delinq_2yrs, inq_last_6mths, credit_history_months, term, home_ownership from f""", "loans raw_loans")
def feature_table(spark, sf):
    """The nine features of every unlocked row, one scan for all roles."""
    return feature_rows(spark, sf).withColumn("annual_inc_log", r9("annual_inc_log"))


@query("feature_value_checks", f"""with v as (select count(*) filter (nullif(trim(loan_amnt), '') is not null and not regexp_matches(trim(loan_amnt), '{NUM}')) as not_numeric_loan_amnt,
    count(*) filter (not regexp_matches(dti, '{NUM}')) as not_numeric_dti, count(*) filter (trim(revol_util) <> '' and not regexp_matches(trim(revol_util), '{NUM}')) as not_numeric_revol_util,
    count(*) filter (not regexp_matches(delinq_2yrs, '{NUM}')) as not_numeric_delinq_2yrs, count(*) filter (not regexp_matches(inq_last_6mths, '{NUM}')) as not_numeric_inq_last_6mths,
    count(*) filter (not regexp_matches(annual_inc, '{NUM}')) as not_numeric_annual_inc, count(*) filter (try_cast(annual_inc as double) < 0) as negative_annual_inc,
    count(*) filter (try_strptime(earliest_cr_line, '%b-%Y') is null) as bad_date_earliest_cr_line, count(*) filter (trim(term) not in ('36 months', '60 months')) as unknown_term,
    count(*) filter (upper(trim(home_ownership)) not in ('MORTGAGE', 'OWN', 'RENT', 'OTHER', 'NONE', 'ANY')) as unknown_home_ownership from raw_loans),
  u as (unpivot v on * into name "check" value violations) select *, violations = 0 as passed from u""", "raw_loans")
def feature_value_checks(spark, sf):
    """Raw values that must not be coerced (negative income is a natural violation here)."""
    return checks.row_checks(views.raw_loans(spark, sf), P.value_rules(P.DEFAULT))


_N = ["loan_amnt", "annual_inc_log", "dti", "revol_util", "delinq_2yrs", "inq_last_6mths", "credit_history_months"]
_PROFILE = ", ".join([f"count(*) filter ({c} is null) as missing_{c}" for c in [*_N, "term", "home_ownership"]]
                     + [f"{s9(f'{a}({c})')} as {a}_{c}" for c in _N for a in ("min", "max")])


@query("split_profile", f"""with {FEATURES_SQL} select split, count(*) as rows, cast(sum(target) as bigint) as events, {_PROFILE} from f group by split""", "loans raw_loans")
def split_profile(spark, sf):
    """A2: rows, events, missing counts and ranges per split in one aggregation."""
    return rounded(P.profile(feature_rows(spark, sf), P.DEFAULT.numeric, P.DEFAULT.categorical)[0])


@query("level_counts", f"""with {FEATURES_SQL} select split, 'term' as "column", term as level, count(*) as rows from f group by all
  union all select split, 'home_ownership', home_ownership, count(*) from f group by all""", "loans raw_loans")
def level_counts(spark, sf):
    """A2: level counts per categorical column."""
    return P.profile(feature_rows(spark, sf), P.DEFAULT.numeric, P.DEFAULT.categorical)[1]


@query("ablation_projection", f"""with {FEATURES_SQL}, s as (select 'all' as variant, count(loan_amnt) + count(annual_inc_log) + count(dti) + count(revol_util) + count(delinq_2yrs)
      + count(inq_last_6mths) + count(credit_history_months) + count(term) + count(home_ownership) as present, 9 as n_features from f
    union all select 'without_loan_information', count(annual_inc_log) + count(dti) + count(revol_util) + count(delinq_2yrs) + count(inq_last_6mths) + count(credit_history_months) + count(home_ownership), 7 from f
    union all select 'without_income_affordability', count(loan_amnt) + count(revol_util) + count(delinq_2yrs) + count(inq_last_6mths) + count(credit_history_months) + count(term), 6 from f
    union all select 'without_credit_behaviour', count(loan_amnt) + count(annual_inc_log) + count(dti) + count(credit_history_months) + count(term) + count(home_ownership), 6 from f
    union all select 'without_credit_history', count(loan_amnt) + count(annual_inc_log) + count(dti) + count(revol_util) + count(delinq_2yrs) + count(inq_last_6mths) + count(term) + count(home_ownership), 8 from f)
  select * from s""", "loans raw_loans")
def ablation_projection(spark, sf):
    """Drop-one-family feature sets, each a projection; the present values of each set."""
    rows = feature_rows(spark, sf)
    sets = P.feature_sets(P.DEFAULT, P.FAMILIES)
    counts = rows.agg(*[F.count(c).alias(c) for c in P.DEFAULT.features])
    total = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    structs = [F.struct(F.lit(v).alias("variant"), total(n).alias("present"), F.lit(len(n)).alias("n_features")) for v, n in sets.items()]
    return counts.select(F.inline(F.array(*structs)))


@query("probability_maths", f"""select loan_id, {s9('ln(p_a / (1 - p_a))')} as margin, {s9('1 / (1 + exp(-ln(p_a / (1 - p_a))))')} as back,
  {s9('1 / (1 + exp(-(0.8::double * ln(least(greatest(p_b, 1e-6::double), 1 - 1e-6::double) / (1 - least(greatest(p_b, 1e-6::double), 1 - 1e-6::double))) - 0.25::double)))')} as calibrated,
  {s9('case when annual_inc <> 0 then loan_amnt / annual_inc else 0 end')} as guarded from loans""", "loans")
def probability_maths(spark, sf):
    """Clipped logit, logistic function, stored Platt mapping, guarded division."""
    return views.loans(spark, sf).select(
        "loan_id", r9(C.logit(F.col("p_a"))).alias("margin"), r9(C.sigmoid(C.logit(F.col("p_a")))).alias("back"),
        r9(C.platt(F.col("p_b"), 0.8, -0.25, 1e-6)).alias("calibrated"), r9(C.ratio(F.col("loan_amnt"), F.col("annual_inc"), 0.0)).alias("guarded"))


@query("month_functions", """select issue_month, cast(left(issue_month, 4) as integer) * 12 + cast(right(issue_month, 2) as integer) - 1 as month_number,
  regexp_matches(issue_month, '^\\d{4}-(0[1-9]|1[0-2])$') as well_formed, count(*) as rows from loans group by all""", "loans")
def month_functions(spark, sf):
    """Month labels, their numbers and the format check."""
    month = F.col("issue_month")
    return views.loans(spark, sf).groupBy("issue_month").agg(F.count(F.lit(1)).alias("rows")).select(
        "issue_month", C.month_number(month).alias("month_number"), C.is_month(month).alias("well_formed"), "rows")


@query("valid_values", """select count(*) filter (annual_inc between 0 and 1) as unit_interval, count(*) filter (isfinite(annual_inc)) as finite, count(*) as rows from loans""", "loans")
def valid_values(spark, sf):
    """finite and unit-interval predicates."""
    return views.loans(spark, sf).agg(
        F.count_if(C.is_probability(F.col("annual_inc"))).alias("unit_interval"), F.count_if(C.is_finite(F.col("annual_inc"))).alias("finite"),
        F.count(F.lit(1)).alias("rows"))


@query("leaf_bounds", """select p_size, cast((100 + p_size) * pow(2, p_size % 6) as bigint) as complexity, count(*) as rows from part group by all""")
def leaf_bounds(spark, sf):
    """leaf-bound complexity from trees and depth."""
    size = F.col("p_size")
    return views.table(spark, sf, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("rows")).select(
        "p_size", C.leaf_bound(size + 100, size % 6).alias("complexity"), "rows")


@query("nested_value", """select event_type, count(*) filter (props ->> '$.k' is not null) as found, count(*) filter (props ->> '$.missing' is null) as missing,
  cast(sum(cast(props ->> '$.k' as bigint)) as bigint) as total from events group by event_type""")
def nested_value(spark, sf):
    """a value at a key path of a JSON record; an absent key is counted."""
    events = views.table(spark, sf, "events")
    k = C.json_value(F.col("props"), "k")
    return events.groupBy("event_type").agg(
        F.count_if(k.isNotNull()).alias("found"), F.count_if(C.json_value(F.col("props"), "missing").isNull()).alias("missing"),
        F.sum(k.cast("long")).alias("total"))


@query("category_crosstab", """select purpose, count(*) filter (target = 0) as non_event, count(*) filter (target = 1) as event,
  """ + s9("avg(loan_amnt) filter (target = 0)", 4) + " as non_event_mean, " + s9("avg(loan_amnt) filter (target = 1)", 4) + " as event_mean from loans group by purpose", "loans")
def category_crosstab(spark, sf):
    """Crosstab of outcome and category, and pivoted outcome means, with explicit pivot values."""
    rows = views.loans(spark, sf).withColumn("outcome", F.when(F.col("target") == 1, "event").otherwise("non_event"))
    out = rows.groupBy("purpose").pivot("outcome", ["non_event", "event"]).agg(F.count(F.lit(1)).alias("n"), F.avg("loan_amnt").alias("mean"))
    return out.select("purpose", F.col("non_event_n").alias("non_event"), F.col("event_n").alias("event"),
                      r9("non_event_mean", 4).alias("non_event_mean"), r9("event_mean", 4).alias("event_mean"))
