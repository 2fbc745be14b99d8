"""Text, lexical and n-gram queries over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline import views
from gradeline.catalog.base import query, r9, rounded, s9
from gradeline.functions import columns as C
from gradeline.functions import text as X
from gradeline.operators import lexical
from gradeline.operators.ordering import exact_quantiles
from gradeline.session import spread

KEYWORDS = ("and", "the", "der", "les", "para", "with")
STOP = ("the", "and", "of", "to", "in", "is", "la", "le", "de", "der", "die", "und", "el", "que")
CAPS = [16, 64, 256, 1024, 4096]

L = r"[\p{L}\p{Nl}\p{No}]"
WORDS = lambda c: f"regexp_extract_all(replace(replace(lower({c}), 'ß', 'ss'), '’', ''''), '{L}+(?:[''-]{L}+)*')"
ITEMS = lambda c: r"len(regexp_extract_all(%s, '[^\s\p{Z}\x0b\x1c-\x1f\x{85}]+'))" % c
SQUEEZE = lambda c: r"trim(regexp_replace(%s, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g'))" % c
HITS = lambda c: f"len(list_filter({c}, lambda t: t in {KEYWORDS!r}))"
FIELDS = """fields as (select doc_id, 'Note ' || source as title, 'text_' || lang as purpose, text as "desc" from documents)"""
PAYLOAD = f"""'Title: ' || title || chr(10) || 'Purpose: ' || replace(purpose, '_', ' ') || case when {SQUEEZE('"desc"')} <> '' then chr(10) || 'Description: ' || {SQUEEZE('"desc"')} else '' end"""
SYL = """case when len(w) <= 3 then 1 else greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))
   - case when regexp_matches(w, 'e$') and not regexp_matches(w, '[ly]e$') then 1 else 0 end + case when regexp_matches(w, '[^aeiouy]le$') then 1 else 0 end) end"""
LEX = f"""lex as (select doc_id, n, ttr, hits, case when n = 0 then 0 else greatest(1, spans) end as sentences, (select sum({SYL}) from (select unnest(plain) as w)) as syl from (
   select doc_id, len(ws) as n, len(list_distinct(ws)) as ttr, {HITS('ws')} as hits,
     len(list_filter(string_split_regex(text, '[.!?]+|\\n+'), lambda s: regexp_matches(s, '{L}'))) as spans,
     list_transform(ws, lambda t: regexp_replace(strip_accents(t), '[^a-z]', '', 'g')) as plain
   from (select doc_id, text, {WORDS('text')} as ws from documents)))"""
LEX_RAW = """doc_id, case when n > 0 then 206.835::double - 1.015::double * (n / sentences) - 84.6::double * (syl / n) else 0 end as flesch_reading_ease,
   case when n > 0 then 0.39::double * (n / sentences) + 11.8::double * (syl / n) - 15.59::double else 0 end as flesch_kincaid_grade,
   case when n > 0 then ttr / n else 0 end as lexical_diversity_ttr, case when n > 0 then hits / n else 0 end as financial_distress_keyword_density"""
FEATURES = ["flesch_reading_ease", "flesch_kincaid_grade", "lexical_diversity_ttr", "financial_distress_keyword_density"]
LEX_OUT = "doc_id, " + ", ".join(f"{s9(f)} as {f}" for f in FEATURES)


def documents(spark, sf):
    return spread(views.table(spark, sf, "documents"), "doc_id")


def pages(spark, sf):
    return spread(views.table(spark, sf, "pages"), "page_id")


def labelled(spark, sf):
    """Documents with a label: what is joined to labels later need not be computed for the others."""
    return documents(spark, sf).join(views.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


def fields(spark, sf, docs=None):
    return (docs or documents(spark, sf)).select(
        "doc_id", F.concat(F.lit("Note "), "source").alias("title"), F.concat(F.lit("text_"), "lang").alias("purpose"), F.col("text").alias("desc"))


def payloads(spark, sf, docs=None):
    parts = {"title": F.col("title"), "purpose": F.col("purpose"), "desc": C.squeeze(F.col("desc"))}
    return fields(spark, sf, docs).select("*", X.payload(parts).alias("text_payload"))


def lexical_rows(spark, sf, docs=None):
    return X.lexical_features((docs or documents(spark, sf)).select("doc_id", "text"), "text", KEYWORDS).drop("text")


@query("payload", f"with {FIELDS} select doc_id, length({PAYLOAD}) as chars, md5({PAYLOAD}) as digest from fields")
def payload(spark, sf):
    """The labelled payload of every document (its length and digest)."""
    return payloads(spark, sf).select("doc_id", F.length("text_payload").cast("long").alias("chars"), F.md5("text_payload").alias("digest"))


@query("label_strip", f"with {FIELDS} select doc_id, md5(trim(regexp_replace({PAYLOAD}, '(?m)^(?:Title|Purpose|Description|Employment title): ', '', 'g'))) as digest from fields")
def label_strip(spark, sf):
    """Field labels removed at line starts only."""
    return payloads(spark, sf).select("doc_id", F.md5(X.strip_labels(F.col("text_payload"))).alias("digest"))


@query("word_tokens", f"select doc_id, len(ws) as words, len(list_distinct(ws)) as distinct_words, md5(array_to_string(ws, ' ')) as digest from (select doc_id, {WORDS('text')} as ws from documents)")
def word_tokens(spark, sf):
    """Word tokens of whole documents."""
    return documents(spark, sf).select("doc_id", X.words(F.col("text")).alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("text_usability", f"select conv_id, turn, {SQUEEZE('text')} <> '' as text_usable, len({WORDS('text')}) > 0 as desc_usable from conversations")
def text_usability(spark, sf):
    """Non-empty payload and at least one word."""
    return views.table(spark, sf, "conversations").select(
        "conv_id", "turn", (C.squeeze(F.col("text")) != "").alias("text_usable"), (F.size(X.words(F.col("text"))) > 0).alias("desc_usable"))


@query("readability", f"""with {LEX} select doc_id, n as words, cast(sentences as bigint) as sentences, cast(coalesce(syl, 0) as bigint) as syllables from lex""")
def readability(spark, sf):
    """Sentence-like spans and syllable estimates."""
    rows = documents(spark, sf).withColumn("w", X.words(F.col("text")))
    total = X.total_syllables(F.col("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), X.sentence_count(F.col("text"), F.size("w")).cast("long").alias("sentences"),
                       total.cast("long").alias("syllables"))


@query("lexical_table", f"with {LEX}, feats as (select {LEX_RAW} from lex) select {LEX_OUT} from feats")
def lexical_table(spark, sf):
    """Readability, type-token ratio and keyword density per document."""
    return rounded(lexical_rows(spark, sf))


@query("keyword_density", f"select conv_id, turn, {HITS('ws')} as hits, {s9(f'case when len(ws) > 0 then {HITS("ws")} / len(ws) else 0 end')} as density from (select conv_id, turn, {WORDS('text')} as ws from conversations)")
def keyword_density(spark, sf):
    """Keyword tokens over all word tokens of one field."""
    rows = views.table(spark, sf, "conversations").withColumn("w", X.words(F.col("text")))
    return rows.select("conv_id", "turn", X.hits(F.col("w"), KEYWORDS).cast("long").alias("hits"), r9(X.density(F.col("w"), KEYWORDS)).alias("density"))


@query("keyword_sources", f"""with {FIELDS}, t as (select doc_id, {WORDS('title')} as a, {WORDS("replace(purpose, '_', ' ')")} as b, {WORDS('"desc"')} as c, {WORDS(PAYLOAD)} as p from fields)
  select doc_id, len(a) as title_words, {HITS('a')} as title_hits, len(b) as purpose_words, {HITS('b')} as purpose_hits, len(c) as desc_words, {HITS('c')} as desc_hits,
    len(p) as payload_words, {HITS('p')} as payload_hits, {HITS('p')} > 0 as payload_has_hit, {HITS('c')} > 0 as desc_has_hit, {HITS('b')} > 0 and {HITS('c')} = 0 as purpose_only_hit from t""")
def keyword_sources(spark, sf):
    """X11: keyword hits attributed to the fields they come from."""
    return lexical.keyword_sources(payloads(spark, sf), KEYWORDS)


LEXICON_SQL = f"""lexicon as (select distinct w as word, (len(w) % 5 - 2) / 2.0::double as polarity, (len(w) % 4) / 4.0::double as subjectivity
  from (select unnest({WORDS('text')}) as w from benchmark))"""


@query("lexicon_sentiment", f"""with {LEXICON_SQL}, t as (select doc_id, unnest({WORDS('text')}) as word from documents), s as (select doc_id, avg(polarity) as p, avg(subjectivity) as s from t join lexicon using (word) group by 1)
  select doc_id, {s9('coalesce(p, 0)')} as sentiment_polarity, {s9('coalesce(s, 0)')} as sentiment_subjectivity from documents left join s using (doc_id)""")
def lexicon_sentiment(spark, sf):
    """Polarity and subjectivity averaged over a caller's lexicon table (here from the benchmark words)."""
    word = views.table(spark, sf, "benchmark").select(F.explode(X.words(F.col("text"))).alias("word")).distinct()
    size = F.length("word")
    table = word.select("word", ((size % 5 - 2) / F.lit(2.0)).alias("polarity"), ((size % 4) / F.lit(4.0)).alias("subjectivity"))
    return rounded(lexical.lexicon_sentiment(documents(spark, sf), "doc_id", X.words(F.col("text")), table))


@query("ordered_sentiment")
def ordered_sentiment(spark, sf):
    """Polarity and subjectivity in token order with negations and intensifiers (a unit test reads tokens in plain Python)."""
    word = views.table(spark, sf, "benchmark").select(F.explode(X.words(F.col("text"))).alias("word")).distinct()
    size = F.length("word")
    kind = F.when(size % 11 == 0, "negation").when(size % 7 == 0, "boost").otherwise("score")
    table = word.select("word", kind.alias("kind"), ((size % 5 - 2) / F.lit(2.0)).alias("polarity"), ((size % 4) / F.lit(4.0)).alias("subjectivity"), F.lit(1.3).alias("intensity"))
    return rounded(lexical.ordered_sentiment(documents(spark, sf), "doc_id", X.words(F.col("text")), table))


QUALITY = "fq as (select unnest(['title', 'purpose', 'desc']) as field, unnest([title, purpose, \"desc\"]) as raw from fields)"
CLEAN = f"case when lower({SQUEEZE('raw')}) in ('nan', 'none', 'null', 'n/a', 'na', '<na>') then '' else {SQUEEZE('raw')} end"


@query("field_quality", f"""with {FIELDS}, {QUALITY}, c as (select field, raw, {CLEAN} as clean from fq)
  select field, count(*) filter (raw is null) as nulls, count(*) filter (coalesce(clean, '') = '') as empty_after_cleaning, count(*) filter (clean <> '') as usable,
    count(distinct clean) filter (clean <> '') as unique_nonempty, count(*) filter (coalesce(raw, '') <> coalesce(clean, '')) as changed_by_cleaning from c group by field""")
def field_quality(spark, sf):
    """Null, empty, usable, unique and changed counts per text field."""
    clean = lambda c: F.when(C.is_missing_marker(c), "").otherwise(C.squeeze(c))
    return lexical.field_quality(fields(spark, sf), ["title", "purpose", "desc"], clean)


@query("length_summary", f"""with {FIELDS}, {QUALITY}, n as (select field, {ITEMS('raw')} as n from fq)
  select field, count(*) as rows, {s9('quantile_cont(n::double, 0.5)')} as median, {s9('quantile_cont(n::double, 0.9)')} as p90, {s9('quantile_cont(n::double, 0.95)')} as p95,
    {s9('quantile_cont(n::double, 0.99)')} as p99, max(n) as longest from n group by field""")
def length_summary(spark, sf):
    """Exact length percentiles per field."""
    long = fields(spark, sf).unpivot([], ["title", "purpose", "desc"], "field", "raw")
    lengths = long.select("field", X.item_count(F.col("raw")).cast("long").alias("n"))
    quantiles = exact_quantiles(lengths, "n", [0.5, 0.9, 0.95, 0.99], ["field"]).groupBy("field").pivot("prob", [0.5, 0.9, 0.95, 0.99]).agg(F.first("quantile"))
    sizes = lengths.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("longest"))
    return sizes.join(quantiles, "field").select(
        "field", "rows", *[r9(F.col(f"`{q}`")).alias(n) for q, n in ((0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))], "longest")


@query("format_patterns", f"""select count(*) as rows, count(*) filter (regexp_matches(html, '</?[A-Za-z][^>]*>')) as tag_rows, count(*) filter (regexp_matches(html, '&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);')) as entity_rows,
  count(*) filter (html <> {SQUEEZE('html')}) as extra_whitespace_rows, cast(sum(len(regexp_extract_all(html, '</?[A-Za-z][^>]*>'))) as bigint) as tags, count(*) filter (regexp_matches(html, '(?i)borrower\\s+added\\s+on')) as wrapper_rows from pages""")
def format_patterns(spark, sf):
    """A10: overlapping format-pattern counts over raw pages."""
    return lexical.format_patterns(pages(spark, sf), "html")


@query("unicode_changed")
def unicode_changed(spark, sf):
    """A10: texts that NFKC changes (SQL has no NFKC; the rule is covered by unit tests)."""
    return documents(spark, sf).groupBy("lang").agg(F.count_if(X.nfkc_changes("text")).alias("changed"), F.count(F.lit(1)).alias("rows"))


@query("clean_pages")
def clean_pages(spark, sf):
    """The shared cleaner over whole pages (unit tests compare it with brute force)."""
    return pages(spark, sf).select("page_id", X.clean_text(F.col("html")).alias("text"))


@query("length_coverage", f"""with n as (select {ITEMS('text')} as n from documents), c as (select unnest({CAPS}) as cap)
  select cast(cap as integer) as cap, {s9('100.0::double * avg((n <= cap)::int)')} as complete_percent, count(*) filter (n > cap) as truncated_rows,
    {s9('100.0::double * sum(greatest(n - cap, 0)) / sum(n)')} as removed_percent from n, c group by cap""")
def length_coverage(spark, sf):
    """Coverage of length caps from the length histogram."""
    return rounded(lexical.cap_coverage(documents(spark, sf).select(X.item_count(F.col("text")).alias("n")), "n", CAPS))


@query("smallest_cap", f"""with n as (select {ITEMS('text')} as n from documents), c as (select unnest({CAPS}) as cap), s as (select cap, avg((n <= cap)::int) as share from n, c group by cap)
  select cast(coalesce(min(cap) filter (share >= 0.99::double), {CAPS[-1]}) as integer) as cap from s""")
def smallest_cap(spark, sf):
    """The smallest tested cap that keeps 99 % of texts whole, else the largest."""
    table = lexical.cap_coverage(documents(spark, sf).select(X.item_count(F.col("text")).alias("n")), "n", CAPS)
    return table.agg(F.coalesce(F.min(F.when(F.col("complete_percent") >= 99.0, F.col("cap"))), F.lit(CAPS[-1])).alias("cap"))


@query("length_ecdf", f"""with n as (select {ITEMS('text')} as v from documents), g as (select v::double as value, count(*) as rows from n group by 1)
  select value, rows, cast(sum(rows) over (order by value) as bigint) as cum, {s9('sum(rows) over (order by value)::double / sum(rows) over ()::double')} as share from g""")
def length_ecdf(spark, sf):
    """Empirical distribution of text lengths."""
    from gradeline.operators.scoring import ecdf

    return rounded(ecdf(documents(spark, sf).select(X.item_count(F.col("text")).alias("n")), "n"))


@query("repeated_payloads", """with g as (select md5(text) as h, count(*) as n from documents group by 1) select count(*) as distinct_payloads, cast(sum(n - 1) as bigint) as repeats, max(n) as largest_group from g""")
def repeated_payloads(spark, sf):
    """Repeated payloads after their first occurrence."""
    return lexical.repeats(documents(spark, sf), F.col("text"))


@query("field_overlap", """select count(*) filter (lower(c_mktsegment) = lower(replace(p, '_', ' '))) as equal_rows, count(*) as rows from
  (select c_mktsegment, case when c_custkey % 2 = 0 then lower(c_mktsegment) else c_mktsegment || '_loan' end as p from customer)""")
def field_overlap(spark, sf):
    """Fields that say the same after case and underscore normalisation."""
    rows = views.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("title"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.lower("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit("_loan"))).alias("purpose"))
    same = F.lower(X.category_words(F.col("title"))) == F.lower(X.category_words(F.col("purpose")))
    return rows.agg(F.count_if(same).alias("equal_rows"), F.count(F.lit(1)).alias("rows"))


@query("category_share", f"select source, lang, count(*) as rows, {s9('100.0::double * count(*) / sum(count(*)) over ()')} as percent from documents group by all")
def category_share(spark, sf):
    """Category frequency with its share."""
    rows = documents(spark, sf)
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    counts = rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(F.broadcast(total)).select("source", "lang", "rows", r9(F.lit(100.0) * F.col("rows") / F.col("_n")).alias("percent"))


@query("cleaning_impact", f"""with {FIELDS}, n as (select {ITEMS(PAYLOAD)} as raw, {ITEMS("regexp_replace(" + PAYLOAD + ", '(?m)^(?:Title|Purpose|Description|Employment title): ', '', 'g')")} as clean from fields)
  select cast(sum(raw) as bigint) as raw_words, cast(sum(clean) as bigint) as clean_words, {s9('100.0::double * (1 - sum(clean)::double / sum(raw)::double)')} as net_reduction_percent from n""")
def cleaning_impact(spark, sf):
    """Word totals before and after a cleaning step, net reduction."""
    rows = payloads(spark, sf)
    return rounded(lexical.cleaning_impact(rows, F.col("text_payload"), X.strip_labels(F.col("text_payload"))))


@query("markup_impact")
def markup_impact(spark, sf):
    """Word totals of raw pages against the shared cleaner's text."""
    rows = pages(spark, sf).select("html", X.clean_text(F.col("html")).alias("clean"))
    return rounded(lexical.cleaning_impact(rows, F.col("html"), F.col("clean")))


# ---- group statistics over the lexical table -------------------------------------------------

LABELLED = f"{LEX}, feats as (select {LEX_RAW} from lex), rows as (select feats.*, quality as target, source as purpose from feats join labels using (doc_id) join documents using (doc_id))"


def labelled_lexical(spark, sf):
    labels = views.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("target"))
    purposes = documents(spark, sf).select("doc_id", F.col("source").alias("purpose"))
    return lexical_rows(spark, sf, labelled(spark, sf)).join(labels, "doc_id").join(purposes, "doc_id")


_CORR = " union all ".join(f"""select '{f}' as feature, {s9(f'corr(target, {f})')} as point_biserial_r, {s9(f'abs(corr(target, {f}))')} as absolute_r,
   {s9(f'avg({f}) filter (target = 0)')} as non_default_mean, {s9(f'avg({f}) filter (target = 1)')} as default_mean,
   {s9(f'avg({f}) filter (target = 1) - avg({f}) filter (target = 0)')} as default_minus_non_default from rows""" for f in FEATURES)


@query("correlations", f"with {LABELLED} {_CORR}")
def correlations(spark, sf):
    """Point-biserial correlation and group means, ranked by absolute r."""
    return rounded(lexical.point_biserial(labelled_lexical(spark, sf), FEATURES).drop("p_value"))


@query("correlation_p_values")
def correlation_p_values(spark, sf):
    """A6 with its p-values: the Student t tail of the bounded (r, n) summary (unit-tested at known points)."""
    return rounded(lexical.point_biserial(labelled_lexical(spark, sf), FEATURES), 6)


_OUT = " union all ".join(f"""select target, '{f}' as feature, count({f}) as "count", {s9(f'avg({f})')} as mean, {s9(f'stddev_samp({f})', 7)} as std, {s9(f'min({f})')} as min,
   {s9(f'quantile_cont({f}, 0.25)')} as q25, {s9(f'quantile_cont({f}, 0.5)')} as median, {s9(f'quantile_cont({f}, 0.75)')} as q75, {s9(f'max({f})')} as max from rows group by target""" for f in FEATURES)


@query("outcome_summary", f"with {LABELLED} {_OUT}")
def outcome_summary(spark, sf):
    """A5: distribution of every feature per outcome, long form."""
    out = lexical.outcome_summary(labelled_lexical(spark, sf).persist(), FEATURES)
    return rounded(out.withColumn("std", r9("std", 7)))


PURPOSE = f"""with {LABELLED}, {FIELDS}, k as (select doc_id, {HITS(WORDS('title'))} as th, {HITS(WORDS("replace(purpose, '_', ' ')"))} as ph, {HITS(WORDS('"desc"'))} as dh,
   len({WORDS('"desc"')}) as dw, {HITS(WORDS(PAYLOAD))} as yh from fields), j as (select rows.*, th, ph, dh, dw, yh from rows join k using (doc_id)),
  p as (select purpose, count(*) as n_loans, cast(sum(target) as bigint) as defaults, avg(target) as rate, avg(flesch_reading_ease) as ease, avg(flesch_kincaid_grade) as grade,
   avg(financial_distress_keyword_density) as dens, avg(case when dw > 0 then dh / dw else 0 end) as ddens, avg((yh > 0)::int) as pm, avg((dh > 0)::int) as dm, avg((ph > 0 and dh = 0)::int) as po,
   cast(sum(yh) as bigint) as payload_distress_hits, cast(sum(ph) as bigint) as purpose_label_distress_hits, cast(sum(th) as bigint) as title_distress_hits, cast(sum(dh) as bigint) as description_distress_hits from j group by purpose)"""


@query("category_summary", f"""{PURPOSE} select purpose, n_loans, defaults, {s9('rate')} as empirical_default_rate, {s9('ease')} as mean_reading_ease, {s9('grade')} as mean_reading_grade,
  {s9('dens')} as mean_distress_keyword_density, {s9('ddens')} as mean_desc_distress_keyword_density, {s9('pm')} as payload_distress_mention_rate, {s9('dm')} as desc_distress_mention_rate,
  {s9('po')} as purpose_label_only_hit_rate, payload_distress_hits, purpose_label_distress_hits, title_distress_hits, description_distress_hits,
  {s9('case when payload_distress_hits > 0 then purpose_label_distress_hits / payload_distress_hits else 0 end')} as purpose_label_share_of_payload_hits from p""")
def category_summary(spark, sf):
    """A4: reading, keyword and outcome measures per category."""
    rows = labelled_lexical(spark, sf).join(lexical.keyword_sources(payloads(spark, sf), KEYWORDS), "doc_id")
    return rounded(lexical.category_summary(rows))


@query("headline_findings", f"""{PURPOSE}, r as (select avg(target) as rate, count(*) as n, sum(target) as d, avg((yh > 0)::int) as pm, sum(ph)::double / nullif(sum(yh), 0) as share from j)
  select n as training_rows, cast(d as bigint) as defaults, {s9('rate')} as empirical_default_rate, (select count(*) from p) as purpose_categories, {s9('pm')} as payload_distress_mention_rate,
    {s9('coalesce(share, 0)')} as purpose_label_share_of_all_payload_hits, (select purpose from p order by rate desc, purpose limit 1) as riskiest_purpose,
    (select arg_max(f, a) from (select unnest({FEATURES}) as f, unnest([abs(corr(target, flesch_reading_ease)), abs(corr(target, flesch_kincaid_grade)), abs(corr(target, lexical_diversity_ttr)), abs(corr(target, financial_distress_keyword_density))]) as a from j)) as strongest_feature from r""")
def headline_findings(spark, sf):
    """Headline findings from row and group aggregates."""
    rows = labelled_lexical(spark, sf).join(lexical.keyword_sources(payloads(spark, sf, labelled(spark, sf)), KEYWORDS), "doc_id").persist()
    return rounded(lexical.headline(rows, FEATURES))


TRAIN_LEX = f"tl as (select t.loan_id, t.doc_id, t.target, t.purpose, feats.* exclude (doc_id) from texts t join feats using (doc_id) where t.split = 'train')"


def training_features(spark, sf):
    """Labelled training texts with the lexical features of the same ids."""
    rows = views.labelled_texts(spark, sf).filter("split = 'train'").select("loan_id", "doc_id", "target", "purpose", "desc").persist()
    features = X.lexical_features(spread(rows.select("loan_id", "desc"), "loan_id"), "desc", KEYWORDS).drop("desc").persist()
    return lexical.join_training_features(rows.drop("desc"), features, FEATURES)


@query("training_feature_join", f"with {LEX}, feats as (select {LEX_RAW} from lex), {TRAIN_LEX} select loan_id, target, purpose, {', '.join(f'{s9(f)} as {f}' for f in FEATURES)} from tl", "texts")
def training_feature_join(spark, sf):
    """Feature table joined to the labelled rows of one split, ids exact both ways, no missing feature."""
    return rounded(training_features(spark, sf).drop("doc_id"))


_LONG = " union all ".join(
    f"select 'correlation' as section, '{f}' as name, 'r' as item, {s9(f'corr(target, {f})')} as value from tl union all "
    f"select 'outcome', '{f}', 'mean_' || target, {s9(f'avg({f})')} from tl group by target" for f in FEATURES)


@query("lexical_analysis", f"with {LEX}, feats as (select {LEX_RAW} from lex), {TRAIN_LEX} {_LONG} union all select 'category', purpose, 'event_rate', {s9('avg(target)')} from tl group by purpose", "texts")
def lexical_analysis(spark, sf):
    """Join, correlations, outcome means and category rates of the training texts in one long table."""
    return rounded(lexical.analysis(training_features(spark, sf).persist(), FEATURES))
