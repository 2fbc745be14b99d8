"""Row-wise tabular features with their value checks, from raw all-text records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.functions import columns as C
from gradeline.operators import checks


@dataclass(frozen=True)
class FeatureSettings:
    """Source columns, derived features, model lists and category levels."""

    source: tuple[str, ...] = ("loan_amnt", "term", "annual_inc", "dti", "revol_util", "delinq_2yrs", "inq_last_6mths",
                               "earliest_cr_line", "home_ownership")
    reference: tuple[str, ...] = ("issue_d",)
    derived: Mapping[str, Mapping[str, object]] = field(default_factory=lambda: {
        "annual_inc_log": {"transform": "log1p", "from": ["annual_inc"]},
        "credit_history_months": {"transform": "months_between", "from": ["earliest_cr_line", "issue_d"]}})
    numeric: tuple[str, ...] = ("loan_amnt", "annual_inc_log", "dti", "revol_util", "delinq_2yrs", "inq_last_6mths",
                                "credit_history_months")
    categorical: tuple[str, ...] = ("term", "home_ownership")
    levels: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        "term": ("36", "60"), "home_ownership": ("MORTGAGE", "OWN", "RENT", "OTHER")})
    home_to_other: tuple[str, ...] = ("NONE", "OTHER", "ANY")
    prohibited: tuple[str, ...] = ("grade", "sub_grade", "int_rate", "installment", "verification_status", "zip_code",
                                   "addr_state", "desc", "title", "emp_title", "synthetic_desc")

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]


DEFAULT = FeatureSettings()
FAMILIES = {
    "loan_information": ["loan_amnt", "term"],
    "income_affordability": ["annual_inc_log", "dti", "home_ownership"],
    "credit_behaviour": ["revol_util", "delinq_2yrs", "inq_last_6mths"],
    "credit_history": ["credit_history_months"],
}


def validate(settings: FeatureSettings, identifier: str = "loan_id", target: str = "target") -> None:
    """Refuse a feature list that leaks, repeats or has no source, before any plan is built."""
    inputs = {c for spec in settings.derived.values() for c in spec["from"]}
    if unknown := inputs - set(settings.source) - set(settings.reference):
        raise checks.ContractError(f"derived features use undeclared columns: {sorted(unknown)}")
    if len(settings.features) != len(set(settings.features)):
        raise checks.ContractError("model feature names must be unique")
    if banned := checks.prohibited({*settings.features, *settings.source, *settings.reference, *inputs}, settings.prohibited):
        raise checks.ContractError(f"prohibited columns used: {banned}")
    if leaked := {identifier, target} & set(settings.features):
        raise checks.ContractError(f"identifier or target configured as a feature: {sorted(leaked)}")
    if unsourced := set(settings.features) - set(settings.source) - set(settings.derived):
        raise checks.ContractError(f"features with no source or derivation: {sorted(unsourced)}")


def feature_sets(settings: FeatureSettings, families: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """'all' and one 'without_<family>' list per family, order kept."""
    checks.require_partition(families, settings.features)
    sets = {"all": settings.features}
    for family, names in families.items():
        sets[f"without_{family}"] = [f for f in settings.features if f not in names]
    return sets


def feature_columns(settings: FeatureSettings):
    """Column expressions of every model feature, in the fixed order."""
    out = []
    for name in settings.numeric:
        spec = settings.derived.get(name)
        out.append(C.derive(name, spec) if spec else C.strict_double(C.blank_to_null(F.col(name))).alias(name))
    levels = {"term": C.term_level(F.col("term")), "home_ownership": C.home_level(C.blank_to_null(F.col("home_ownership")), settings.home_to_other)}
    return [*out, *[levels[name].alias(name) for name in settings.categorical]]


def value_rules(settings: FeatureSettings):
    """Row rules for raw values that may not be coerced to missing."""
    plain = [c for c in settings.numeric if c not in settings.derived]
    rules = {f"not_numeric_{c}": C.not_numeric(C.blank_to_null(F.col(c))) for c in [*plain, "annual_inc"]}
    start = C.blank_to_null(F.col("earliest_cr_line"))
    rules["negative_annual_inc"] = C.is_negative(C.strict_double(C.blank_to_null(F.col("annual_inc"))))
    rules["bad_date_earliest_cr_line"] = start.isNotNull() & C.parse_month(start).isNull()
    rules["unknown_term"] = C.unknown_level(F.col("term"), C.term_level(F.col("term")), settings.levels["term"])
    rules["unknown_home_ownership"] = C.unknown_level(
        F.col("home_ownership"), C.home_level(F.col("home_ownership"), settings.home_to_other), settings.levels["home_ownership"])
    return rules


def build(raw: DataFrame, registry: DataFrame, settings: FeatureSettings = DEFAULT) -> DataFrame:
    """Registry rows with their features and target; one scan serves every split and role."""
    validate(settings)
    needed = list(dict.fromkeys([*settings.source, *settings.reference]))
    if missing := checks.missing_columns(raw, needed):
        raise checks.ContractError(f"raw table is missing columns: {missing}")
    keys = [c for c in ("loan_id", "split", "role", "issue_month", "target") if c in registry.columns]
    joined = registry.select(*keys, "source_row_number").join(raw.select("source_row_number", *needed), "source_row_number", "left")
    return joined.select(*keys, *feature_columns(settings))


def profile(features: DataFrame, numeric: Sequence[str], categorical: Sequence[str], by: str = "split") -> tuple[DataFrame, DataFrame]:
    """(wide profile, level counts): rows, events, missing per column, range per numeric column."""
    wide = features.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("target").cast("long").alias("events"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in [*numeric, *categorical]],
        *[agg(c).alias(f"{name}_{c}") for c in numeric for name, agg in (("min", F.min), ("max", F.max))])
    levels = features.unpivot([by], list(categorical), "column", "level").groupBy(by, "column", "level").agg(F.count(F.lit(1)).alias("rows"))
    return wide, levels
