"""Row-wise Column functions for tabular features, months and probabilities."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a text field.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
# Text that a strict numeric cast accepts.
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)$"
# Month labels, identifiers and the term label.
MONTH_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])$"
ID_PATTERN = r"^lc_\d{9}$"
TERM_PATTERN = r"^(\d+) months$"
MISSING_MARKERS = ("nan", "none", "null", "n/a", "na", "<na>")
LOG_LOSS_EPS = 2.220446049250313e-16


def strip(value: Column) -> Column:
    """Unicode strip; Spark's trim removes only the space character."""
    return F.regexp_replace(value, f"^{_SPACE}+|{_SPACE}+$", "")


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def is_blank(value: Column) -> Column:
    """True for NULL, empty and white-space-only raw text."""
    return strip(F.coalesce(value, F.lit(""))) == ""


def is_missing_marker(value: Column) -> Column:
    return F.lower(strip(value)).isin(*MISSING_MARKERS)


def squeeze(value: Column) -> Column:
    """Runs of white space become one space, ends stripped."""
    return strip(F.regexp_replace(value, f"{_SPACE}+", " "))


def strict_double(value: Column) -> Column:
    """Double for numeric text, NULL otherwise; pair it with ``not_numeric`` as a check."""
    return F.when(value.rlike(_NUMBER), value.try_cast("double"))


def not_numeric(value: Column) -> Column:
    return F.coalesce(value.isNotNull() & ~value.rlike(_NUMBER), F.lit(False))


def log1p(value: Column) -> Column:
    """log(1+x) where x >= 0; a negative value is NULL here and counted by ``is_negative``."""
    return F.when(value >= 0, F.log1p(value))


def is_negative(value: Column) -> Column:
    return F.coalesce(value < 0, F.lit(False))


def parse_month(value: Column) -> Column:
    """'Mon-YYYY' text to a date, NULL when it does not parse."""
    return F.try_to_date(value, "MMM-yyyy")


def whole_months_between(start: Column, end: Column) -> Column:
    """Whole calendar months between two dates, as double."""
    return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("double")


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_number(month: Column) -> Column:
    """Running month number, so adjacent months differ by one."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def is_month(month: Column) -> Column:
    return F.coalesce(month.rlike(MONTH_PATTERN), F.lit(False))


def record_id(row_number: Column) -> Column:
    return F.format_string("lc_%09d", row_number)


def term_level(value: Column) -> Column:
    """' 36 months' to '36'; text that does not match gives NULL."""
    return F.nullif(F.regexp_extract(strip(value), TERM_PATTERN, 1), F.lit(""))


def home_level(value: Column, to_other: Sequence[str]) -> Column:
    upper = F.upper(strip(value))
    return F.when(upper.isin(*to_other), F.lit("OTHER")).otherwise(upper)


def unknown_level(raw: Column, level: Column, allowed: Sequence[str]) -> Column:
    """A present raw value whose normalised level is not allowed."""
    return blank_to_null(raw).isNotNull() & ~F.coalesce(level.isin(*allowed), F.lit(False))


def ratio(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    """Guarded division: a zero denominator gives ``otherwise``."""
    quotient = numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")
    return quotient if otherwise is None else F.coalesce(quotient, F.lit(float(otherwise)))


def clip(value: Column, eps: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(eps))), F.lit(1.0 - eps))


def logit(p: Column, eps: float = 1e-12) -> Column:
    clipped = clip(p, eps)
    return F.ln(clipped / (F.lit(1.0) - clipped))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def platt(p: Column, slope: float, intercept: float, eps: float) -> Column:
    return sigmoid(F.lit(float(slope)) * logit(p, eps) + F.lit(float(intercept)))


def is_finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def is_probability(p: Column) -> Column:
    return F.coalesce(~F.isnan(p) & p.between(0.0, 1.0), F.lit(False))


def differs(left: Column, right: Column, atol: float, rtol: float = 0.0) -> Column:
    """Outside atol + rtol*|right|; a missing or NaN side differs, and so does an infinite one from anything but itself."""
    a, b = left.cast("double"), right.cast("double")
    odd = F.isnan(a) | F.isnan(b) | ((F.abs(b) == float("inf")) | (F.abs(a) == float("inf"))) & (a != b)
    apart = (a != b) & (F.abs(a - b) > F.lit(float(atol)) + F.lit(float(rtol)) * F.abs(b))
    return F.coalesce(odd | apart, F.lit(True))


def threshold_grid(start: float, stop: float, step: float) -> list[float]:
    """Inclusive grid of rounded values, so 0.07 is exactly 0.07."""
    count = round((stop - start) / step)
    return [round(start + (stop - start) * i / count, 12) for i in range(count + 1)]


def year_bucket(month: Column, early_until: str, early_label: str) -> Column:
    year = F.substring(month, 1, 4)
    return F.when(year >= early_until, year).otherwise(F.lit(early_label))


def leaf_bound(trees: Column, depth: Column) -> Column:
    return (trees * F.pow(F.lit(2), depth)).cast("long")


def json_value(document: Column, *path: str) -> Column:
    """Value at a nested key path; a missing key is NULL and shows up in a check."""
    return F.get_json_object(document, "$" + "".join(f"['{key}']" for key in path))


# Registry of row-wise derivations: name -> (number of source columns, Column builder).
TRANSFORMS: dict[str, tuple[int, Callable[..., Column]]] = {
    "log1p": (1, lambda x: log1p(strict_double(blank_to_null(x)))),
    "months_between": (2, lambda s, e: whole_months_between(parse_month(strip(s)), parse_month(strip(e)))),
}


def derive(name: str, spec: Mapping[str, object]) -> Column:
    """One derived feature from its ``{"transform": ..., "from": [...]}`` entry."""
    transform, sources = spec.get("transform"), list(spec.get("from", []))
    if transform not in TRANSFORMS:
        raise ValueError(f"unsupported transform for {name}: {transform!r}")
    arity, build = TRANSFORMS[transform]
    if len(sources) != arity:
        raise ValueError(f"{name} ({transform}) needs {arity} source columns, got {sources}")
    return build(*(F.col(source) for source in sources)).alias(name)
