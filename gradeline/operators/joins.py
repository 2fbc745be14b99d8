"""Checked key joins: base rows drive, cardinality and match are counted, nothing is filled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.operators.checks import check_rows, coverage_checks, enforce
from gradeline.operators.ordering import attach


def left_join(base: DataFrame, other: DataFrame, key: str = "loan_id") -> DataFrame:
    """Left join that keeps a ``_matched`` flag for the checks."""
    return base.join(other.withColumn("_matched", F.lit(True)), key, "left").withColumn(
        "_matched", F.coalesce("_matched", F.lit(False)))


def join_checks(base: DataFrame, other: DataFrame, key: str = "loan_id") -> DataFrame:
    """Repeated keys on either side and base keys with no match, from one shuffle of the keys."""
    tagged = base.select(key, F.lit(1).alias("_b"), F.lit(0).alias("_o")).unionByName(
        other.select(key, F.lit(0).alias("_b"), F.lit(1).alias("_o")))
    per_key = tagged.groupBy(key).agg(F.sum("_b").alias("_b"), F.sum("_o").alias("_o"))
    extra = lambda c: F.sum(F.greatest(F.col(c) - 1, F.lit(0)))
    sums = per_key.agg(
        extra("_b").alias("repeated_base_keys"), extra("_o").alias("repeated_other_keys"),
        F.count_if((F.col("_b") > 0) & (F.col("_o") == 0)).alias("unmatched_base_rows"),
        F.count_if((F.col("_b") == 0) & (F.col("_o") > 0)).alias("unused_other_rows"))
    return check_rows(sums, ["repeated_base_keys", "repeated_other_keys", "unmatched_base_rows", "unused_other_rows"])


def checked_join(base: DataFrame, other: DataFrame, key: str = "loan_id", exact: bool = False, name: str = "join") -> DataFrame:
    """One-to-one left join; a repeated key or a base row without a match raises.

    ``exact`` also refuses rows of ``other`` that no base row uses.
    """
    checks = join_checks(base, other, key)
    enforce(checks if exact else checks.filter("check <> 'unused_other_rows'"), name)
    return base.join(other, key, "left")


def join_scores(base: DataFrame, tracks: Mapping[str, DataFrame], key: str = "loan_id", check: bool = True) -> DataFrame:
    """Left join of every track's score table onto the base rows."""
    joined = base
    for track, scores in tracks.items():
        joined = checked_join(joined, scores, key, name=track) if check else joined.join(scores, key, "left")
    return joined


def with_track_prefix(frame: DataFrame, track: str, columns: Sequence[str] = ("model_name", "model_version")) -> DataFrame:
    return frame.withColumnsRenamed({c: f"{track}_{c}" for c in columns if c in frame.columns})


def attach_roles(rows: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their role, and the checks: every row mapped, split labels equal."""
    joined = left_join(rows, mapping.select("loan_id", F.col("split").alias("_split"), "role"))
    checks = check_rows(joined.agg(
        F.count_if(~F.col("_matched")).alias("rows_without_role"),
        F.count_if(F.col("_matched") & (F.col("split") != F.col("_split"))).alias("split_disagrees")),
        ["rows_without_role", "split_disagrees"])
    return joined.drop("_matched", "_split"), checks


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows that differ per column over the shared keys, NULL equal to NULL."""
    other = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = left.select(key, *columns).join(other, key)
    return joined.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "mismatches")


def outer_agreement(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Full outer comparison: keys on one side only and rows whose columns disagree."""
    a = left.select(key, F.struct(*columns).alias("_a"))
    b = right.select(key, F.struct(*columns).alias("_b"))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))).alias("disagreeing"))


def ids_in(rows: DataFrame, ids: DataFrame, key: str = "loan_id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def ids_not_in(rows: DataFrame, ids: DataFrame, key: str = "loan_id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def align(expected: DataFrame, features: DataFrame, keys: Sequence[str] = ("loan_id", "split"), position: str = "position") -> tuple[DataFrame, DataFrame]:
    """Features in the order of an expected key list that carries its own position column."""
    checks = coverage_checks(features, expected, keys)
    return expected.join(features, list(keys), "left").orderBy(position), checks


__all__ = [
    "align", "attach", "attach_roles", "checked_join", "ids_in", "ids_not_in", "join_checks", "join_scores", "left_join",
    "mismatches", "outer_agreement", "with_track_prefix",
]
