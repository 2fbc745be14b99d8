"""Registry of named queries and the independent SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_VIEWS = {"loans": views.LOANS_SQL, "raw_loans": views.RAW_LOANS_SQL, "texts": views.TEXTS_SQL}


def query(name: str, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Register a query; ``uses`` names the shared views its SQL starts from."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(uses, sql)
        return build

    return register


def with_views(uses: str, sql: str) -> str:
    text = sql.strip()
    heads = [_VIEWS[v] for v in uses.split()]
    if not heads:
        return text
    if text[:5].lower() == "with ":
        return "with " + ",\n".join(heads) + ",\n" + text[5:]
    return "with " + ",\n".join(heads) + "\n" + text


def r9(value: Column | str, digits: int = 9) -> Column:
    """Rounded output, without a negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, digits) + F.lit(0.0)


def s9(expression: str, digits: int = 9) -> str:
    """The SQL spelling of ``r9``."""
    return f"(round({expression}, {digits}) + cast(0 as double))"


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column of a result table."""
    return df.select(*[
        r9(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])
