"""Carve the labelled cohort out of raw records and hand on only its unlocked part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.functions import columns as C
from gradeline.operators import checks
from gradeline.operators.roles import split_column


@dataclass(frozen=True)
class CohortSettings:
    """Frozen eligibility rule, split months and version labels."""

    first_month: str
    last_month: str
    splits: tuple[tuple[str, str, str], ...]
    cohort: str
    dataset_version: str
    event_status: str = "Charged Off"
    other_status: str = "Fully Paid"


SETTINGS = CohortSettings(
    "1995-01", "2001-12",
    (("train", "1995-01", "1999-12"), ("validation", "2000-01", "2000-12"), ("test", "2001-01", "2001-12")),
    "matured_text_v1", "orders_v1")

LOADABLE = ("train", "validation")


def eligible(raw: DataFrame, settings: CohortSettings) -> DataFrame:
    """Allowed status, a description that is not blank, and a parseable month inside the range."""
    month = C.month_label(C.parse_month(F.col("issue_d")))
    return raw.withColumn("issue_month", month).filter(
        F.col("loan_status").isin(settings.event_status, settings.other_status)
        & ~C.is_blank(F.col("desc")) & F.col("issue_month").between(settings.first_month, settings.last_month))


def registry(raw: DataFrame, settings: CohortSettings) -> DataFrame:
    """The eight registry columns of every eligible record."""
    return eligible(raw, settings).select(
        C.record_id(F.col("source_row_number")).alias("loan_id"), "source_row_number",
        split_column(F.col("issue_month"), settings.splits).alias("split"), "issue_month",
        F.when(F.col("loan_status") == settings.event_status, 1).otherwise(0).alias("target"),
        F.lit(1).alias("text_available"), F.lit(settings.cohort).alias("cohort"),
        F.lit(settings.dataset_version).alias("dataset_version"))


def diagnostics(raw: DataFrame, settings: CohortSettings) -> DataFrame:
    """Raw rows, eligible rows and descriptions that are only a literal missing marker, in one scan."""
    month = C.month_label(C.parse_month(F.col("issue_d")))
    ok = (F.col("loan_status").isin(settings.event_status, settings.other_status)
          & ~C.is_blank(F.col("desc")) & month.between(settings.first_month, settings.last_month))
    ok = F.coalesce(ok, F.lit(False))
    return raw.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(ok).alias("eligible_rows"),
        F.count_if(ok & C.is_missing_marker(F.col("desc"))).alias("literal_missing_marker_descriptions"))


def development_view(table: DataFrame) -> DataFrame:
    """Everything but the locked split."""
    return table.filter(F.col("split").isin(*LOADABLE))


def split_statistics(table: DataFrame) -> DataFrame:
    """Rows per split; label figures only for unlocked splits."""
    open_split = F.col("split").isin(*LOADABLE)
    return table.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").cast("long").alias("_e"),
                                      F.avg("target").alias("_r")).select(
        "split", "rows", F.when(open_split, F.col("_e")).alias("events"), F.when(open_split, F.col("_r")).alias("event_rate"))


def split_targets(table: DataFrame, split: str) -> DataFrame:
    """Ids and targets of one split; the locked split is refused before any read."""
    if split == "test":
        raise ValueError("only train and validation are available; the final test set is locked")
    if split not in LOADABLE:
        raise ValueError(f"unknown split: {split!r}")
    return table.filter(F.col("split") == split).select("loan_id", "target")


def registry_checks(table: DataFrame, statistics: DataFrame, settings: CohortSettings) -> DataFrame:
    """Row rules, unique keys and agreement with the recorded split counts."""
    rules = checks.registry_rules(table)
    rules["wrong_cohort"] = F.col("cohort") != settings.cohort
    rules["wrong_dataset_version"] = F.col("dataset_version") != settings.dataset_version
    keys = checks.key_quality(table, ["loan_id", "source_row_number"]).select(
        F.concat(F.lit("unique_"), "column").alias("check"), (F.col("missing") + F.col("repeats")).alias("violations"),
        ((F.col("missing") + F.col("repeats")) == 0).alias("passed"))
    counts = checks.count_checks(table, "split", statistics).select(
        F.concat(F.lit("rows_"), "split").alias("check"), F.abs(F.col("rows") - F.col("expected_rows")).alias("violations"), "passed")
    return checks.row_checks(table, rules).unionByName(keys).unionByName(counts)


def audit(rebuilt: DataFrame, locked: DataFrame) -> DataFrame:
    """Named comparison of a rebuilt registry with the locked one, in one check table."""
    from gradeline.operators.joins import mismatches

    fields = [c for c in locked.columns if c != "loan_id"]
    cover = checks.coverage(rebuilt, locked, ["loan_id"]).unpivot([], ["missing", "extra", "duplicates"], "check", "violations")
    rows = mismatches(rebuilt, locked, "loan_id", fields).select(
        F.concat(F.lit("mismatch_"), "column").alias("check"), F.col("mismatches").alias("violations"))
    left = rebuilt.groupBy("split").agg(F.count(F.lit(1)).alias("_l"))
    right = locked.groupBy("split").agg(F.count(F.lit(1)).alias("_r"))
    counts = left.join(right, "split", "full_outer").agg(
        F.count_if(~F.col("_l").eqNullSafe(F.col("_r"))).alias("violations")).select(F.lit("split_counts").alias("check"), "violations")
    out = cover.unionByName(rows).unionByName(counts)
    return out.withColumn("passed", F.col("violations") == 0)
