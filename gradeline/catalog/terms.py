"""N-gram vocabulary, TF-IDF and term-interpretation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline import views
from gradeline.catalog.base import query, r9, rounded, s9
from gradeline.catalog.cohort import U
from gradeline.catalog.text import STOP, documents
from gradeline.functions.sampling import hash_uniform
from gradeline.operators import terms

K = 400
TOK = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t not in {STOP!r})"
GRAMS = lambda t: f"list_concat({t}, case when len({t}) >= 2 then list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]) else [] end)"


def tf_sql(n: int, source: str = "documents", keep: str = "", column: str = "text") -> str:
    """CTE tf(doc_id, keep..., term, tf) with n-grams up to n words."""
    k = f"{keep}, " if keep else ""
    grams = "ts" if n == 1 else GRAMS("ts")
    return f"""tk as (select doc_id, {k}{TOK(column)} as ts from {source}),
  tf as (select doc_id, {k}term, count(*) as tf from (select doc_id, {k}unnest({grams}) as term from tk) group by all)"""


def vocab_sql(k: int, docs: str = "(select count(*) from documents)", source: str = "tf") -> str:
    return f"""vb as (select term, cast(sum(tf) as bigint) as total, count(*) as df, ln((1 + {docs}) / (1 + count(*))::double) + 1 as idf from {source}
    group by term order by total desc, term limit {k})"""


def counts(spark, sf, n=1, keep=()):
    return terms.term_counts(documents(spark, sf), "text", STOP, (1, n), keep=keep)


def text_counts(spark, sf, n=1):
    """Term counts of the labelled texts with their role, month and outcome."""
    rows = views.labelled_texts(spark, sf).filter("split <> 'test'")
    return rows, terms.term_counts(rows, "desc", STOP, (1, n), keep=["role", "issue_month", "target"])


@query("vocabulary", f"with {tf_sql(2)}, {vocab_sql(K)} select term, total, df, {s9('idf')} as idf from vb")
def vocabulary(spark, sf):
    """Unigrams and bigrams by corpus count, document frequency and smoothed idf."""
    return rounded(terms.vocabulary(counts(spark, sf, 2), documents(spark, sf), K))


_TFIDF = f"""w as (select doc_id, term, {{tf}} * idf as w from tf join vb using (term)), n as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from w)"""


@query("tfidf_weights", f"with {tf_sql(1)}, {vocab_sql(K)}, {_TFIDF.format(tf='tf')} select doc_id, term, {s9('weight')} as weight from n")
def tfidf_weights(spark, sf):
    """L2-normalised TF-IDF weights."""
    table = counts(spark, sf).persist()
    return rounded(terms.tfidf(table, terms.vocabulary(table, documents(spark, sf), K), sublinear=False))


@query("tfidf_sublinear", f"with {tf_sql(2)}, {vocab_sql(K)}, {_TFIDF.format(tf='(1 + ln(tf))')} select doc_id, count(*) as terms, {s9('sum(weight)')} as total_weight, {s9('max(weight)')} as top_weight from n group by doc_id")
def tfidf_sublinear(spark, sf):
    """Sublinear term frequency over unigrams and bigrams, summarised per document."""
    table = counts(spark, sf, 2)
    weights = terms.tfidf(table, terms.vocabulary(table, documents(spark, sf), K))
    return rounded(weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("total_weight"), F.max("weight").alias("top_weight")))


@query("document_frequency", f"with {tf_sql(1, keep='lang')} select lang, term, count(*) as documents from tf group by all having count(*) >= 10")
def document_frequency(spark, sf):
    """Documents per term and category."""
    return terms.document_frequency(counts(spark, sf, 1, ["lang"]), ["lang"]).filter("documents >= 10")


TEXT_BASE = """t as (select * from texts where split <> 'test')"""
FIT = "fit as (select * from tf where role = 'base_fit')"
FIT_DOCS = "(select count(*) from t where role = 'base_fit')"


@query("vocabulary_coverage", f"""with {TEXT_BASE}, {tf_sql(2, 't', 'role', '"desc"')}, {FIT}, {vocab_sql(K, FIT_DOCS, 'fit')}
  select role, case when contains(tf.term, ' ') then 'bigram' else 'unigram' end as kind, cast(sum(tf) as bigint) as occurrences, cast(coalesce(sum(tf) filter (vb.term is not null), 0) as bigint) as covered,
    {s9('100.0::double * coalesce(sum(tf) filter (vb.term is not null), 0)::double / sum(tf)::double')} as covered_percent from tf left join vb on tf.term = vb.term where role <> 'base_fit' group by all""", "texts")
def vocabulary_coverage(spark, sf):
    """How much of each scoring role's text the fit-role vocabulary covers."""
    rows, table = text_counts(spark, sf, 2)
    table = table.persist()
    vocab = terms.vocabulary(table.filter("role = 'base_fit'"), rows.filter("role = 'base_fit'"), K)
    return rounded(terms.coverage(table.filter("role <> 'base_fit'"), vocab, ["role"]))


@query("empty_vectors", f"with {tf_sql(1)}, {vocab_sql(20)} select doc_id from documents where doc_id not in (select doc_id from tf join vb using (term))")
def empty_vectors(spark, sf):
    """Documents without any vocabulary term."""
    table = counts(spark, sf).persist()
    return terms.empty_rows(documents(spark, sf).select("doc_id"), table, terms.vocabulary(table, documents(spark, sf), 20))


# A descriptive coefficient per term: smoothed log odds of document frequency between the classes.
COEF = f"""{TEXT_BASE}, {tf_sql(2, 't', 'role, issue_month, target', '"desc"')}, {vocab_sql(K, '(select count(*) from t)')},
  cf as (select term, count(*) as documents, ln((1 + sum(target)) / (1 + count(*) - sum(target))::double) - ln((1 + (select sum(target) from t)) / (1 + (select count(*) - sum(target) from t))::double) as coefficient
    from tf where term in (select term from vb) group by term),
  hi as (select * from cf order by coefficient desc, term limit 15), lo as (select * from cf order by coefficient, term limit 15),
  tp as (select *, 'higher_risk' as direction from hi union all select *, 'lower_risk' from lo)"""


def coefficient_table(spark, sf):
    rows, table = text_counts(spark, sf, 2)
    vocab = terms.vocabulary(table, rows, K).persist()
    # All that follows reads vocabulary terms alone: only these counts are kept, not those of every n-gram.
    table = table.join(F.broadcast(vocab.select("term")), "term", "left_semi").persist()
    totals = rows.agg(F.sum("target").alias("_pos"), F.count(F.lit(1)).alias("_n"))
    per_term = table.join(F.broadcast(vocab.select("term")), "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("target").alias("_p"))
    odds = lambda p, n: F.ln((1 + p) / (1 + n - p))
    coefs = per_term.join(F.broadcast(totals)).select(
        "term", "documents", (odds(F.col("_p"), F.col("documents")) - odds(F.col("_pos"), F.col("_n"))).alias("coefficient")).persist()
    return rows, table, vocab, coefs


@query("top_terms", f"with {COEF} select term, documents, {s9('coefficient')} as coefficient, direction from tp", "texts")
def top_terms(spark, sf):
    """Strongest terms in both directions with their document frequency."""
    return rounded(terms.top_terms(coefficient_table(spark, sf)[3], 15))


@query("within_field_counts", f"""with {COEF}, ft as (select doc_id, unnest([title, replace(purpose, '_', ' '), "desc"]) as ftext from t), fk as (select {TOK('ftext')} as ts from ft),
  fg as (select unnest(list_distinct({GRAMS('ts')})) as term from fk)
  select tp.term, count(fg.term) as within_field_documents from (select distinct term from tp) tp left join fg on fg.term = tp.term group by tp.term""", "texts")
def within_field_counts(spark, sf):
    """Document counts of the ranked terms inside single fields."""
    rows, _, _, coefs = coefficient_table(spark, sf)
    picked = terms.top_terms(coefs, 15).select("term").distinct()
    fields = rows.withColumn("purpose", F.translate("purpose", "_", " "))
    return terms.within_fields(fields, ["title", "purpose", "desc"], picked, STOP, (1, 2))


VOL = f"""{COEF}, bt as (select issue_month as bucket, sum(tf) as n from tf where term in (select term from vb) group by 1),
  br as (select d.term, bt.bucket, 1e6::double * coalesce((select sum(tf) from tf where tf.term = d.term and tf.issue_month = bt.bucket), 0) / bt.n as rate from (select distinct term from tp) d, bt),
  vl as (select term, case when min(rate) > 0 then max(rate) / min(rate) else 'Infinity'::double end as ratio, (list(bucket order by rate desc, bucket))[1] as peak_bucket, (list(bucket order by rate, bucket))[1] as trough_bucket from br group by term)"""


@query("term_volatility", f"with {VOL} select term, case when isinf(ratio) then ratio else {s9('ratio')} end as volatility_ratio, peak_bucket, trough_bucket from vl", "texts")
def term_volatility(spark, sf):
    """Per-million frequency swing of the ranked terms across months, with peak and trough."""
    _, table, vocab, coefs = coefficient_table(spark, sf)
    picked = terms.top_terms(coefs, 15).select("term").distinct()
    out = terms.volatility(table.withColumnRenamed("issue_month", "bucket"), vocab, picked)
    ratio = F.col("volatility_ratio")
    return out.withColumn("volatility_ratio", F.when(ratio == float("inf"), ratio).otherwise(r9(ratio)))


@query("term_flags", f"""with {VOL}, ft as (select doc_id, unnest([title, replace(purpose, '_', ' '), "desc"]) as ftext from t), fk as (select {TOK('ftext')} as ts from ft),
  fg as (select term, count(*) as w from (select unnest(list_distinct({GRAMS('ts')})) as term from fk) group by term),
  j as (select tp.*, vl.ratio, coalesce(w, 0) as w, 100.0::double * documents / (select count(*) from t) as pct from tp join vl using (term) left join fg using (term)),
  k as (select *, pct < 1.0 as low_document_frequency, contains(term, ' ') and w / documents::double <= 0.2 as cross_field_bigram, ratio > 10 as period_specific from j)
  select term, direction, documents, w as within_field_documents, {s9('pct')} as document_percent, low_document_frequency, cross_field_bigram, period_specific,
    cast(low_document_frequency::int + cross_field_bigram::int + period_specific::int as integer) as artefact_flags, low_document_frequency::int + cross_field_bigram::int + period_specific::int = 0 as retained from k""", "texts")
def term_flags(spark, sf):
    """Ranked coefficients with artefact flags."""
    rows, table, vocab, coefs = coefficient_table(spark, sf)
    top = terms.top_terms(coefs, 15).persist()
    picked = top.select("term").distinct()
    fields = rows.withColumn("purpose", F.translate("purpose", "_", " "))
    ranked = top.join(F.broadcast(terms.within_fields(fields, ["title", "purpose", "desc"], picked, STOP, (1, 2))), "term").join(
        F.broadcast(terms.volatility(table.withColumnRenamed("issue_month", "bucket"), vocab, picked)), "term")
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    out = terms.flag_terms(ranked.join(F.broadcast(total)), F.col("_n"))
    return out.select("term", "direction", "documents", "within_field_documents", r9("document_percent").alias("document_percent"),
                      "low_document_frequency", "cross_field_bigram", "period_specific", "artefact_flags", "retained")


CASES = f"""v as (select loan_id, target, p_a, {U.format(salt='review-42', key='loan_id')} as u from loans where role = 'validation'),
  e as (select *, 'false_positive' as error_type, row_number() over (order by p_a desc, loan_id) as k from v where target = 0 and p_a >= 0.5
    union all select *, 'false_negative', row_number() over (order by p_a, loan_id) from v where target = 1 and p_a < 0.5),
  r as (select *, row_number() over (partition by error_type order by u, loan_id) as m from e where k > 10)"""


@query("review_cases", f"""with {CASES} select loan_id, target, p_a, error_type, 'strongest' as sample_group from e where k <= 10
  union all select loan_id, target, p_a, error_type, 'random' from r where m <= 10""", "loans")
def review_cases(spark, sf):
    """Per error type the ten strongest errors and a seeded draw of ten from the rest."""
    rows = views.loans(spark, sf).filter("role = 'validation'")
    out = terms.review_cases(rows, "p_a", 0.5, 20, 10, hash_uniform(F.col("loan_id"), "review-42"))
    return out.select("loan_id", "target", "p_a", "error_type", "sample_group")


@query("term_contributions", f"""with {COEF}, wt as (select doc_id, term, (1 + ln(tf)) * idf as w from tf join vb using (term)), nw as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from wt),
  cs as (select doc_id, case when target = 0 then 'false_positive' else 'false_negative' end as error_type from t),
  sc as (select doc_id, error_type, term, weight * coefficient as c, documents from cs join nw using (doc_id) join cf using (term) where documents >= 5),
  rk as (select *, row_number() over (partition by doc_id order by abs(c) desc, term) as k from sc where case when error_type = 'false_positive' then c > 0 else c < 0 end)
  select error_type, term as ngram, count(*) as case_count, {s9('avg(c)')} as mean_log_odds_contribution, max(documents) as train_document_count from rk where k <= 5 group by all""", "texts")
def term_contributions(spark, sf):
    """Leading n-grams among the score contributions of each outcome group."""
    rows, table, vocab, coefs = coefficient_table(spark, sf)
    cases = rows.select("doc_id", F.when(F.col("target") == 0, "false_positive").otherwise("false_negative").alias("error_type"))
    return rounded(terms.contributions(cases, terms.tfidf(table, vocab), coefs, 5, 5))
