"""Score fusion: per-track score tables, the joined fusion table, and scoring with a fallback."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.columns import is_probability, platt, sigmoid
from gradeline.operators import checks
from gradeline.operators.joins import join_scores


def score_column(track: str) -> str:
    return f"p_default_{track}"


def version_column(track: str) -> str:
    return f"{track}_model_version"


def prediction_table(rows: DataFrame, p: Column, name: str, version: str, probability: str = "p_default_tabular") -> DataFrame:
    """The flat prediction table (id, split, probability, model name, model version)."""
    return rows.select("loan_id", "split", p.cast("double").alias(probability), F.lit(name).alias("model_name"),
                       F.lit(version).alias("model_version"))


def tabular_track(predictions: DataFrame, track: str = "tabular", probability: str = "p_default_tabular") -> DataFrame:
    return predictions.select("loan_id", F.col(probability).alias(score_column(track)), F.col("model_version").alias(version_column(track)))


def export_track(export: DataFrame, track: str) -> DataFrame:
    return export.select("loan_id", F.col("raw_prob").alias(score_column(track)), F.col("model_version").alias(version_column(track)))


def union_track(parts: Sequence[DataFrame], mapping: DataFrame, track: str) -> DataFrame:
    """Several files of one track as one table; overlap or inexact coverage raises."""
    scores = reduce(DataFrame.unionByName, parts)
    checks.enforce(checks.coverage_checks(scores, mapping, ["loan_id"]), f"{track} scores")
    return tabular_track(scores, track)


def expected_ids(rows: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """(set, loan_id, target) for every scoring set, from roles and never from a score file."""
    member = F.array_compact(F.array(*[F.when(F.col("role").isin(*roles), F.lit(name)) for name, roles in sets.items()]))
    return rows.filter("split <> 'test'").select(F.explode(member).alias("set"), "loan_id", "target")


def load_candidate(name: str, files: Mapping[str, DataFrame], expected: DataFrame) -> DataFrame:
    """(candidate, set, loan_id, p, target, model_name, model_version) of one candidate's score files.

    ``expected`` holds (set, loan_id, target). Every file must keep the prediction contract over exactly its set's ids, name its set's
    split, and all files must share one filled model name and version. Outcomes are attached by id; no file brings any.
    """
    parts = []
    for set_name, table in files.items():
        own = expected.filter(F.col("set") == set_name)
        checks.enforce(checks.prediction_checks(table, own), f"{name}, {set_name}")
        parts.append(table.join(own, "loan_id").select(
            F.lit(name).alias("candidate"), "set", "loan_id", F.col("p_default_tabular").cast("double").alias("p"), "target", "split", "model_name", "model_version"))
    rows = reduce(DataFrame.unionByName, parts)
    named = rows.agg(*[F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(f"empty_{c}") for c in ("model_name", "model_version")],
                     *[(F.count_distinct(c) - 1).alias(f"several_{c}") for c in ("model_name", "model_version")])
    splits = rows.groupBy("set").agg(F.count_distinct("split").alias("n")).agg(F.sum(F.col("n") - 1).alias("mixed_split"))
    checks.enforce(checks.check_rows(named, named.columns), f"{name}, model")
    checks.enforce(checks.check_rows(splits, ["mixed_split"]), f"{name}, split")
    return rows.drop("split")


def fusion_table(mapping: DataFrame, tracks: Mapping[str, DataFrame]) -> DataFrame:
    """The role mapping with every track's score and version; a missing score raises."""
    return join_scores(mapping, tracks).select(
        "loan_id", "split", "role", *[c for t in tracks for c in (score_column(t), version_column(t))])


def fusion_checks(table: DataFrame, mapping: DataFrame, versions: Mapping[str, str]) -> DataFrame:
    """Exact columns and ids, labels equal to the mapping, finite scores in [0, 1], pinned versions."""
    if banned := checks.prohibited(table.columns, ("target",)):
        raise checks.ContractError(f"outcome columns in a hand-off: {banned}")
    checks.require_columns(table, ["loan_id", "split", "role", *[c for t in versions for c in (score_column(t), version_column(t))]])
    rules = {f"invalid_{t}": ~is_probability(F.col(score_column(t))) for t in versions}
    rules |= {f"wrong_{t}_version": ~F.col(version_column(t)).eqNullSafe(F.lit(v)) for t, v in versions.items()}
    labelled = table.join(mapping.select("loan_id", F.struct("split", "role").alias("_labels")), "loan_id", "left")
    rules["labels_disagree"] = ~F.struct("split", "role").eqNullSafe(F.col("_labels"))
    return checks.coverage_checks(table, mapping, ["loan_id"]).unionByName(checks.row_checks(labelled, rules))


def stacker_probability(tracks: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    """Logistic regression on the track probabilities with stored numbers."""
    margin = reduce(lambda a, b: a + b, [F.lit(float(c)) * F.col(score_column(t)) for t, c in zip(tracks, coefficients, strict=True)])
    return sigmoid(margin + F.lit(float(intercept)))


def predict(rows: DataFrame, artifact: Mapping[str, object], text_usable: str = "text_usable") -> DataFrame:
    """Score every row from its base probabilities, or the calibrated tabular fallback without usable text.

    Works on batch and streaming frames. Input that a caller may not send (a missing or invalid
    score, a text score beside unusable text) is not scored: ``reject_reason`` says why.
    """
    tracks = list(artifact["tracks"])
    cal, fallback = artifact["calibrator"], artifact["fallback"]
    usable, tabular = F.col(text_usable), F.col(score_column("tabular"))
    text_tracks = [t for t in tracks if t != "tabular"]
    some = lambda conditions: reduce(lambda a, b: a | b, conditions, F.lit(False))
    missing = lambda t: F.col(score_column(t)).isNull()
    invalid = lambda t: ~is_probability(F.col(score_column(t)))
    reason = (
        F.when(usable.isNull(), "text_flag_missing").when(missing("tabular"), "missing_score").when(invalid("tabular"), "bad_score")
        .when(~usable & some([~missing(t) for t in text_tracks]), "text_score_without_text")
        .when(usable & some([missing(t) for t in tracks]), "missing_score")
        .when(usable & some([invalid(t) for t in tracks]), "bad_score")
    )
    stacked = platt(stacker_probability(tracks, artifact["coefficients"], artifact["intercept"]), cal["slope"], cal["intercept"], cal["probability_clip"])
    single = platt(tabular, fallback["slope"], fallback["intercept"], fallback["probability_clip"])
    ok = F.col("reject_reason").isNull()
    pick = lambda a, b: F.when(ok, F.when(usable, a).otherwise(b))
    return rows.withColumn("reject_reason", reason).select(
        *rows.columns, pick(stacked, single).alias("p_default"),
        pick(F.lit("fusion_stacker"), F.lit("tabular_fallback")).alias("source"), F.when(ok, ~usable).alias("fallback"),
        pick(F.lit(",".join(tracks)), F.lit("tabular")).alias("tracks_used"),
        pick(F.lit(f"{artifact['stacker_version']}/{artifact['variant']}"), F.lit(fallback["version"])).alias("model_version"),
        "reject_reason")


def artifact_checks(artifact: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """Agreement of a one-row artifact table with the settings, field by field."""
    rules = {}
    for field, value in expected.items():
        wanted = F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)
        rules[field.replace(".", "_")] = ~F.col(field).eqNullSafe(wanted)
    return checks.row_checks(artifact, rules)


#: Which versions (by pattern) are held against which baseline.
PAIRINGS = ((".+", "reference"), (".+_platt", "tabular_only_platt"))


def version_pairs(versions: Sequence[str], pairings: Sequence[tuple[str, str]] = PAIRINGS) -> list[tuple[str, str]]:
    """(candidate, baseline) for every pairing whose baseline is among the versions."""
    return [(candidate, baseline) for pattern, baseline in pairings if baseline in versions
            for candidate in versions if candidate != baseline and re.fullmatch(pattern, candidate)]


def wide_predictions(long: DataFrame, versions: Sequence[str], stacker_version: str) -> DataFrame:
    """Long (loan_id, role, version, p) to one row per id with a column per version."""
    wide = long.groupBy("loan_id", "role").pivot("version", list(versions)).agg(F.first("p"))
    return wide.select("loan_id", "role", *[F.col(v).alias(f"p_{v}") for v in versions], F.lit(stacker_version).alias("stacker_version"))
