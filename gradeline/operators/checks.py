"""Table contracts. A check is a row (check, violations, passed); nothing raises until ``enforce``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.columns import ID_PATTERN, differs, is_finite, is_probability, sigmoid, strip

# Outcome fields that may never be a source, an input or a feature.
ALWAYS_PROHIBITED = frozenset({
    "loan_status", "out_prncp", "out_prncp_inv", "total_pymnt", "total_pymnt_inv", "total_rec_prncp",
    "total_rec_int", "total_rec_late_fee", "recoveries", "collection_recovery_fee", "last_pymnt_d",
    "last_pymnt_amnt", "next_pymnt_d", "last_credit_pull_d", "pymnt_plan", "hardship_flag", "hardship_type",
    "hardship_reason", "hardship_status", "hardship_amount", "hardship_start_date", "hardship_end_date",
    "hardship_length", "hardship_dpd", "hardship_loan_status", "hardship_payoff_balance_amount",
    "hardship_last_payment_amount", "deferral_term", "payment_plan_start_date",
    "orig_projected_additional_accrued_interest", "debt_settlement_flag", "debt_settlement_flag_date",
    "settlement_status", "settlement_date", "settlement_amount", "settlement_percentage", "settlement_term",
    "synthetic_desc",
})
PREDICTION_COLUMNS = ("loan_id", "split", "p_default_tabular", "model_name", "model_version")
EXPORT_COLUMNS = ("loan_id", "split", "role", "raw_margin", "raw_prob", "model_version")


class ContractError(ValueError):
    """Raised by ``enforce`` with every failed check."""


def check_rows(sums: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One-row (per group) violation counts to check rows."""
    typed = sums.select(*by, *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names])
    return typed.unpivot(list(by), list(names), "check", "violations").withColumn("passed", F.col("violations") == 0)


def row_checks(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Count the rows that violate each rule, all rules in one aggregation."""
    sums = df.groupBy(*by).agg(*[F.count_if(F.coalesce(rule, F.lit(True))).alias(n) for n, rule in rules.items()])
    return check_rows(sums, list(rules), by)


def examples(df: DataFrame, rule: Column, key: str, columns: Sequence[str], k: int = 3) -> DataFrame:
    """The first k offending rows by key."""
    return df.filter(F.coalesce(rule, F.lit(True))).orderBy(key).limit(k).select(key, *columns)


def coverage(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact two-sided key coverage: (missing, extra, duplicates) in one shuffle.

    Both sides are counted per key before they meet, so copies of one key never pile up.
    """
    keys = list(keys)
    tagged = actual.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_e")).unionByName(
        expected.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_e")))
    per_key = tagged.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_e").alias("_e"))
    return per_key.agg(
        F.count_if(F.col("_a") == 0).alias("missing"), F.count_if(F.col("_e") == 0).alias("extra"),
        F.coalesce(F.sum(F.greatest(F.col("_a") - 1, F.lit(0))), F.lit(0)).cast("long").alias("duplicates"))


def coverage_checks(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return check_rows(coverage(actual, expected, keys), ["missing", "extra", "duplicates"])


def key_quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, distinct and repeated counts of every key column."""
    parts = []
    for key in keys:
        per_value = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(per_value.agg(
            F.lit(key).alias("column"),
            F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("_n"))), F.lit(0)).cast("long").alias("missing"),
            F.count_if(F.col("_k").isNotNull()).alias("distinct_values"),
            F.coalesce(F.sum(F.when(F.col("_k").isNotNull(), F.col("_n") - 1)), F.lit(0)).cast("long").alias("repeats")))
    return reduce(DataFrame.unionByName, parts)


def one_value(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that must hold one non-blank value: distinct values, blanks, smallest value."""
    parts = [
        df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.lit(c).alias("column"), F.count_if(F.col("value").isNotNull()).alias("distinct_values"),
            F.coalesce(F.sum(F.when(F.coalesce(strip(F.col("value").cast("string")), F.lit("")) == "", F.col("_n"))), F.lit(0))
            .cast("long").alias("blank_rows"), F.min("value").alias("first_value"))
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts).withColumn(
        "passed", (F.col("distinct_values") == 1) & (F.col("blank_rows") == 0))


def disjointness(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Ids shared by each pair of named id sets: (left_set, right_set, shared)."""
    names = list(sets)
    tagged = reduce(DataFrame.unionByName, [
        sets[name].select(key, F.lit(1 << i).alias("_bit")) for i, name in enumerate(names)])
    masks = tagged.groupBy(key).agg(F.bit_or("_bit").alias("_mask")).groupBy("_mask").agg(F.count(F.lit(1)).alias("_n"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    asked = F.explode(F.array(*[
        F.struct(F.lit(names[i]).alias("left_set"), F.lit(names[j]).alias("right_set"),
                 F.lit((1 << i) | (1 << j)).alias("bits")) for i, j in pairs])).alias("_p")
    return masks.select("*", asked).groupBy("_p.left_set", "_p.right_set").agg(
        F.coalesce(F.sum(F.when(F.col("_mask").bitwiseAND(F.col("_p.bits")) == F.col("_p.bits"), F.col("_n"))), F.lit(0))
        .cast("long").alias("shared"))


def tables_agree(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows on one side only, over the shared projection (copies counted)."""
    tagged = left.select(*columns, F.lit(1).alias("_d")).unionByName(right.select(*columns, F.lit(-1).alias("_d")))
    return tagged.groupBy(*columns).agg(F.sum("_d").alias("_d")).agg(
        F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).cast("long").alias("left_only"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).cast("long").alias("right_only"))


def count_checks(df: DataFrame, group: str, recorded: DataFrame) -> DataFrame:
    """Rows per group against a bounded recorded table (group, expected_rows)."""
    seen = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    return seen.join(recorded, group, "full_outer").select(
        group, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("expected_rows", F.lit(0)).alias("expected_rows"),
    ).withColumn("passed", F.col("rows") == F.col("expected_rows"))


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Header check on the schema alone; no job."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, expected: Sequence[str]) -> None:
    if df.columns != list(expected):
        raise ContractError(f"expected columns {list(expected)} in that order, got {df.columns}")


def prohibited(columns: Iterable[str], extra: Iterable[str] = ()) -> list[str]:
    return sorted(set(columns) & (ALWAYS_PROHIBITED | set(extra)))


def require_partition(families: Mapping[str, Sequence[str]], features: Sequence[str]) -> None:
    """Every feature in exactly one non-empty family."""
    flat = [name for family in families.values() for name in family]
    if any(not family for family in families.values()) or sorted(flat) != sorted(features):
        raise ContractError(f"families {dict(families)} do not partition {list(features)}")


def registry_rules(df: DataFrame) -> dict[str, Column]:
    """Row rules of the registry: identifiers, row numbers, flags and splits."""
    number = F.col("source_row_number")
    return {
        "bad_identifier": ~F.col("loan_id").rlike(ID_PATTERN),
        "bad_row_number": number < 1,
        "identifier_row_mismatch": F.col("loan_id") != F.format_string("lc_%09d", number),
        "unknown_split": ~F.col("split").isin("train", "validation", "test"),
        "bad_text_flag": ~F.col("text_available").isin(0, 1),
        "bad_target": (F.col("split") != "test") & ~F.coalesce(F.col("target").isin(0, 1), F.lit(False)),
    }


def prediction_checks(frame: DataFrame, expected_ids: DataFrame, probability: str = "p_default_tabular") -> DataFrame:
    """The prediction-table contract: columns, unique ids, exact coverage, values in [0, 1]."""
    require_columns(frame, [probability if c == "p_default_tabular" else c for c in PREDICTION_COLUMNS])
    if frame.schema[probability].dataType.typeName() not in ("double", "float", "integer", "long", "decimal"):
        raise ContractError(f"{probability} must be numeric")
    p = F.col(probability)
    values = row_checks(frame, {"null_probability": p.isNull(), "outside_unit_interval": p.isNotNull() & ~is_probability(p)})
    return coverage_checks(frame, expected_ids, ["loan_id"]).unionByName(values)


def export_checks(frame: DataFrame, mapping: DataFrame, version: str, tolerance: float = 1e-9) -> DataFrame:
    """The six-column score export: coverage, labels equal to the mapping, p = sigmoid(margin), one version."""
    require_columns(frame, EXPORT_COLUMNS)
    joined = frame.join(
        mapping.select("loan_id", F.col("split").alias("_split"), F.col("role").alias("_role")), "loan_id", "left")
    margin, prob = F.col("raw_margin"), F.col("raw_prob")
    rows = row_checks(joined, {
        "split_disagrees": ~F.col("split").eqNullSafe(F.col("_split")),
        "role_disagrees": ~F.col("role").eqNullSafe(F.col("_role")),
        "margin_not_finite": ~is_finite(margin),
        "probability_invalid": ~is_probability(prob),
        "not_sigmoid_of_margin": differs(prob, sigmoid(margin), tolerance),
        "wrong_version": ~F.col("model_version").eqNullSafe(F.lit(version)),
    })
    return coverage_checks(frame, mapping, ["loan_id"]).unionByName(rows)


def binary_target_checks(df: DataFrame, target: str = "target") -> DataFrame:
    y = F.col(target)
    sums = df.agg(
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("target_not_binary"),
        (F.lit(2) - F.count_distinct(F.when(y.isin(0, 1), y))).alias("classes_missing"))
    return check_rows(sums, ["target_not_binary", "classes_missing"])


def enforce(checks: DataFrame, what: str = "table") -> None:
    """Run the check rows (a bounded table) and raise with every failure."""
    failed = checks.filter(~F.col("passed")).collect()
    if failed:
        raise ContractError(f"{what}: " + "; ".join(
            ", ".join(f"{k}={v}" for k, v in row.asDict().items() if k != "passed") for row in failed))
