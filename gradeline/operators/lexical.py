"""Group statistics over text features, and text-table quality profiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.columns import ratio, squeeze
from gradeline.functions.text import DISTRESS_KEYWORDS, ENTITY_PATTERN, TAG_PATTERN, category_words, hits, item_count, words
from gradeline.operators.checks import ContractError, binary_target_checks, enforce, row_checks
from gradeline.operators.joins import checked_join
from gradeline.operators.ordering import attach, exact_quantiles
from gradeline.session import small_side


def keyword_sources(rows: DataFrame, keywords: Sequence[str] = DISTRESS_KEYWORDS, key: str = "doc_id") -> DataFrame:
    """Word and keyword counts of title, purpose, description and payload, and what they say together."""
    source = {"title": F.col("title"), "purpose": category_words(F.col("purpose")), "desc": F.col("desc"), "payload": F.col("text_payload")}
    tokens = rows.select(key, *[words(F.coalesce(c, F.lit(""))).alias(f"_{n}") for n, c in source.items()])
    counts = [c for n in source for c in (
        F.size(f"_{n}").cast("long").alias(f"{n}_words"), hits(F.col(f"_{n}"), keywords).cast("long").alias(f"{n}_hits"))]
    return tokens.select(key, *counts).select(
        "*", (F.col("payload_hits") > 0).alias("payload_has_hit"), (F.col("desc_hits") > 0).alias("desc_has_hit"),
        ((F.col("purpose_hits") > 0) & (F.col("desc_hits") == 0)).alias("purpose_only_hit"))


def lexicon_sentiment(docs: DataFrame, key: str, tokens: Column, lexicon: DataFrame) -> DataFrame:
    """Mean polarity and subjectivity of the tokens that a (word, polarity, subjectivity) table knows; 0 without any.

    The lexicon meets the tokens first, so only sums per document are shuffled. It is broadcast only after its size is
    checked; a larger one is joined by shuffle, where adaptive execution splits a hot word.
    """
    known = docs.select(key, F.explode(tokens).alias("word")).join(small_side(lexicon), "word")
    scored = known.groupBy(key).agg(F.avg("polarity").alias("_p"), F.avg("subjectivity").alias("_s"))
    return docs.select(key).join(scored, key, "left").select(
        key, F.coalesce("_p", F.lit(0.0)).alias("sentiment_polarity"), F.coalesce("_s", F.lit(0.0)).alias("sentiment_subjectivity"))


NEGATED_SHARE = -0.5


def ordered_sentiment(docs: DataFrame, key: str, tokens: Column, lexicon: DataFrame) -> DataFrame:
    """Polarity and subjectivity of each document read in token order, from a table (word, kind, polarity, subjectivity, intensity).

    ``kind`` is score, boost or negation. A boost multiplies the next word's numbers by its intensity, and boosts in a row multiply; a
    negation turns the next word's polarity by -0.5, and with boosts between the two their intensity divides. Any other word of two
    or more letters in between ends the effect; single letters are passed over. Numbers stay within [-1, 1] and [0, 1]; a document is
    the mean of its scored words, 0 without any. Only words of the table leave the scan; a fold over them in order is the state
    machine. ``key`` must be unique.
    """
    words = docs.select(key, F.posexplode(F.filter(tokens, lambda t: F.length(t) > 1)).alias("at", "word"))
    known = words.join(small_side(lexicon), "word").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("at", "kind", "polarity", "subjectivity", "intensity"))).alias("_w"))
    number = F.lit(0.0)
    start = F.struct(F.lit(-2).alias("at"), F.lit(1.0).alias("boost"), F.lit(False).alias("negated"), number.alias("p"), number.alias("s"), F.lit(0).alias("n"))

    def step(state: Column, w: Column) -> Column:
        near = state["at"] == w["at"] - 1
        boost = F.when(near, state["boost"]).otherwise(1.0)
        negated = near & state["negated"]
        factor = F.when(negated, F.lit(NEGATED_SHARE) / boost).otherwise(boost)
        polarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w["polarity"] * factor))
        subjectivity = F.greatest(number, F.least(F.lit(1.0), w["subjectivity"] * F.when(negated, 1.0 / boost).otherwise(boost)))
        scores, boosts = w["kind"] == "score", w["kind"] == "boost"
        return F.struct(
            w["at"].alias("at"), F.when(boosts, boost * w["intensity"]).otherwise(1.0).alias("boost"),
            F.when(boosts, negated).otherwise(w["kind"] == "negation").alias("negated"),
            (state["p"] + F.when(scores, polarity).otherwise(0.0)).alias("p"), (state["s"] + F.when(scores, subjectivity).otherwise(0.0)).alias("s"),
            (state["n"] + scores.cast("int")).alias("n"))

    read = known.select(key, F.aggregate("_w", start, step).alias("_r"))
    mean = lambda c: F.coalesce(ratio(F.col(f"_r.{c}"), F.col("_r.n"), 0.0), F.lit(0.0))
    return docs.select(key).join(read, key, "left").select(key, mean("p").alias("sentiment_polarity"), mean("s").alias("sentiment_subjectivity"))


def point_biserial(rows: DataFrame, features: Sequence[str], target: str = "target") -> DataFrame:
    """Correlation with a binary target, group means and two-sided p-value; a constant feature raises.

    Only one summary row per feature reaches the driver.
    """
    long = rows.unpivot([target], list(features), "feature", "x")
    summary = long.groupBy("feature").agg(
        F.count("x").alias("n"), ratio(F.covar_pop(F.col(target).cast("double"), "x"), F.stddev_pop(target) * F.stddev_pop("x")).alias("r"),
        (F.min("x") < F.max("x")).alias("varies"),
        F.avg(F.when(F.col(target) == 0, F.col("x"))).alias("m0"), F.avg(F.when(F.col(target) == 1, F.col("x"))).alias("m1")).collect()
    if flat := [s["feature"] for s in summary if not s["varies"]]:
        raise ContractError(f"constant features have no correlation: {sorted(flat)}")
    out = [(s["feature"], s["r"], abs(s["r"]), correlation_p_value(s["r"], s["n"]), s["m0"], s["m1"], s["m1"] - s["m0"]) for s in summary]
    out.sort(key=lambda row: (-row[2], row[0]))
    return rows.sparkSession.createDataFrame(
        out, "feature string, point_biserial_r double, absolute_r double, p_value double, non_default_mean double, default_mean double, default_minus_non_default double")


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided Student t tail of a correlation, through the regularised incomplete beta function."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return student_tail(n - 2, r * r)


def student_tail(freedom: int, share: float) -> float:
    """Two-sided Student tail for t**2 = freedom * share / (1 - share).

    Up to 10**6 degrees it is the regularised incomplete beta function by its continued fraction, in log space with a series for the
    ratio of gamma functions; beyond, the normal tail of Wallace's transformed t, whose error falls with the square of the degrees.
    """
    if share <= 0:
        return 1.0
    if freedom > 1_000_000:
        z = (8 * freedom + 1) / (8 * freedom + 3) * math.sqrt(-freedom * math.log1p(-share))
        return math.erfc(z / math.sqrt(2))
    a = freedom / 2.0
    front = math.exp(_log_gamma_ratio(a) - math.lgamma(0.5) + a * math.log1p(-share) + 0.5 * math.log(share))
    if share < 1.5 / (a + 2.5):
        return 1.0 - front * _beta_fraction(0.5, a, share) / 0.5
    return front * _beta_fraction(a, 0.5, 1.0 - share) / a


def _log_gamma_ratio(a: float) -> float:
    """ln(gamma(a + 1/2) / gamma(a)); the difference of two large logarithms would lose its last digits."""
    if a < 20:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5) + 17 / (14336 * a**7)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated forwards until it no longer changes."""
    small = 1e-300
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1)) or small)
    value = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + term * d) or small)
            c = (1.0 + term / c) or small
            value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return value


def outcome_summary(rows: DataFrame, features: Sequence[str], target: str = "target") -> DataFrame:
    """Count, mean, sample deviation, range and quartiles of every feature per outcome."""
    long = rows.unpivot([target], list(features), "feature", "x")
    by = [target, "feature"]
    base = long.groupBy(*by).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    probs = {0.25: "q25", 0.5: "median", 0.75: "q75"}
    quartiles = exact_quantiles(long, "x", list(probs), by).groupBy(*by).pivot("prob", list(probs)).agg(F.first("quantile"))
    return base.join(quartiles, by).select(*by, "count", "mean", "std", "min", *[F.col(f"`{q}`").alias(n) for q, n in probs.items()], "max")


def category_summary(rows: DataFrame, by: str = "purpose") -> DataFrame:
    """Fourteen aggregates per category and the guarded label share of all hits."""
    flag = lambda c: F.avg(F.col(c).cast("int"))
    total = lambda c: F.sum(c).cast("long")
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_loans"), total("target").alias("defaults"), F.avg("target").alias("empirical_default_rate"),
        F.avg("flesch_reading_ease").alias("mean_reading_ease"), F.avg("flesch_kincaid_grade").alias("mean_reading_grade"),
        F.avg("financial_distress_keyword_density").alias("mean_distress_keyword_density"),
        F.avg(ratio(F.col("desc_hits"), F.col("desc_words"), 0.0)).alias("mean_desc_distress_keyword_density"),
        flag("payload_has_hit").alias("payload_distress_mention_rate"), flag("desc_has_hit").alias("desc_distress_mention_rate"),
        flag("purpose_only_hit").alias("purpose_label_only_hit_rate"), total("payload_hits").alias("payload_distress_hits"),
        total("purpose_hits").alias("purpose_label_distress_hits"), total("title_hits").alias("title_distress_hits"),
        total("desc_hits").alias("description_distress_hits"))
    return out.withColumn("purpose_label_share_of_payload_hits", ratio(F.col("purpose_label_distress_hits"), F.col("payload_distress_hits"), 0.0))


def headline(rows: DataFrame, features: Sequence[str], by: str = "purpose") -> DataFrame:
    """One row of headline findings: sizes, rates, label share, riskiest category, strongest feature."""
    strongest = point_biserial(rows, features).select("feature", "absolute_r")
    groups = rows.groupBy(by).agg(F.avg("target").alias("_rate"))
    picked = groups.agg(F.count(F.lit(1)).alias("purpose_categories"), F.min(F.struct((-F.col("_rate")).alias("r"), F.col(by).alias("b"))).alias("_b"))
    overall = rows.agg(
        F.count(F.lit(1)).alias("training_rows"), F.sum("target").cast("long").alias("defaults"), F.avg("target").alias("empirical_default_rate"),
        F.avg(F.col("payload_has_hit").cast("int")).alias("payload_distress_mention_rate"),
        ratio(F.sum("purpose_hits"), F.sum("payload_hits"), 0.0).alias("purpose_label_share_of_all_payload_hits"))
    out = attach(attach(overall, picked, []), strongest.agg(F.max_by("feature", "absolute_r").alias("strongest_feature")), [])
    return out.select(*overall.columns, "purpose_categories", F.col("_b.b").alias("riskiest_purpose"), "strongest_feature")


def field_quality(rows: DataFrame, fields: Sequence[str], clean: Callable[[Column], Column]) -> DataFrame:
    """Null, empty, usable, unique and changed counts per text field; texts are compared by digest."""
    long = rows.unpivot([], list(fields), "field", "raw").withColumn("_clean", clean(F.col("raw")))
    usable = F.coalesce(F.col("_clean"), F.lit("")) != ""
    compared = long.select("field", F.col("raw").isNull().alias("_null"), usable.alias("_ok"),
                           (F.coalesce("raw", F.lit("")) != F.coalesce("_clean", F.lit(""))).alias("_changed"),
                           F.when(usable, F.sha2(F.col("_clean"), 256)).alias("_digest"))
    per_text = compared.groupBy("field", "_digest").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_null").alias("_null"), F.count_if("_ok").alias("_ok"), F.count_if("_changed").alias("_changed"))
    return per_text.groupBy("field").agg(
        F.sum("_null").alias("nulls"), (F.sum("_n") - F.sum("_ok")).alias("empty_after_cleaning"), F.sum("_ok").alias("usable"),
        F.count("_digest").alias("unique_nonempty"), F.sum("_changed").alias("changed_by_cleaning"))


def format_patterns(rows: DataFrame, column: str) -> DataFrame:
    text = F.col(column)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(text.rlike(TAG_PATTERN)).alias("tag_rows"), F.count_if(text.rlike(ENTITY_PATTERN)).alias("entity_rows"),
        F.count_if(text != squeeze(text)).alias("extra_whitespace_rows"), F.sum(F.regexp_count(text, F.lit(TAG_PATTERN))).cast("long").alias("tags"),
        F.count_if(text.rlike(r"(?i)borrower\s+added\s+on")).alias("wrapper_rows"))


def cap_coverage(lengths: DataFrame, length: str, caps: Sequence[int]) -> DataFrame:
    """Whole, truncated and removed shares per length cap; rows collapse to a length histogram first."""
    histogram = lengths.groupBy(F.col(length).alias("_n")).agg(F.count(F.lit(1)).alias("_rows"))
    per_cap = histogram.select("*", F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap"))
    whole = F.col("_n") <= F.col("cap")
    return per_cap.groupBy("cap").agg(
        (F.lit(100.0) * F.sum(F.when(whole, F.col("_rows")).otherwise(0)) / F.sum("_rows")).alias("complete_percent"),
        F.sum(F.when(whole, 0).otherwise(F.col("_rows"))).alias("truncated_rows"),
        (F.lit(100.0) * F.sum(F.greatest(F.col("_n") - F.col("cap"), F.lit(0)) * F.col("_rows")) / F.sum(F.col("_n") * F.col("_rows"))).alias("removed_percent"))


def repeats(rows: DataFrame, text: Column) -> DataFrame:
    """Distinct payloads and repeats after the first occurrence, grouped by digest."""
    groups = rows.groupBy(F.sha2(text, 256).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.count(F.lit(1)).alias("distinct_payloads"), F.sum(F.col("_n") - 1).alias("repeats"), F.max("_n").alias("largest_group"))


def cleaning_impact(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    sums = rows.agg(F.sum(item_count(before)).cast("long").alias("raw_words"), F.sum(item_count(after)).cast("long").alias("clean_words"))
    return sums.withColumn("net_reduction_percent", F.lit(100.0) * (1 - ratio(F.col("clean_words"), F.col("raw_words"))))


def join_training_features(rows: DataFrame, features: DataFrame, columns: Sequence[str], key: str = "loan_id") -> DataFrame:
    """Labelled rows of one split with their features: exact id membership both ways, no missing value, both outcomes."""
    enforce(binary_target_checks(rows), "training rows")
    joined = checked_join(rows, features.select(key, *columns), key, exact=True, name="lexical features")
    enforce(row_checks(joined, {f"missing_{c}": F.col(c).isNull() for c in columns}), "lexical features")
    return joined


def analysis(rows: DataFrame, features: Sequence[str], by: str = "purpose") -> DataFrame:
    """The lexical analysis as one long table (section, name, item, value): correlations, outcome means, category rates."""
    correlations = point_biserial(rows, features).select(
        F.lit("correlation").alias("section"), F.col("feature").alias("name"), F.lit("r").alias("item"), F.col("point_biserial_r").alias("value"))
    outcomes = outcome_summary(rows, features).select(
        F.lit("outcome").alias("section"), F.col("feature").alias("name"), F.concat(F.lit("mean_"), F.col("target").cast("string")).alias("item"), F.col("mean").alias("value"))
    categories = rows.groupBy(by).agg(F.avg("target").alias("value")).select(
        F.lit("category").alias("section"), F.col(by).alias("name"), F.lit("event_rate").alias("item"), "value")
    return correlations.unionByName(outcomes).unionByName(categories)
