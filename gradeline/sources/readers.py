"""Readers: text-only CSV records with row numbers, score files and JSON artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gradeline.operators.checks import ContractError, check_rows, missing_columns
from gradeline.session import small_side


def read_raw_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = True) -> DataFrame:
    """Every column as text; an empty cell is NULL, text such as NA stays literal.

    Quoted fields may span lines. That keeps each file in one split, so large sources should
    come as many files (or as one-line records with ``multi_line=False``).
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', inferSchema=False)
    if columns and (missing := missing_columns(raw, columns)):
        raise ContractError(f"raw table is missing columns: {missing}")
    return raw


def with_source_row_number(raw: DataFrame, name: str = "source_row_number") -> DataFrame:
    """Number data records from 1 in file order, before any filter.

    A record's place inside its block is its increasing id less the block's smallest. The block
    table (one row per file block) turns block sizes into starting points.
    """
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                        F.monotonically_increasing_id().alias("_id"))
    blocks = placed.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(small_side(blocks, 1_000_000), ["_file", "_start"]).select(
        *raw.columns, (F.col("_id") + F.col("_shift") + 1).alias(name))


def record_count_check(raw: DataFrame, recorded: int) -> DataFrame:
    """Records read against the recorded count."""
    return check_rows(raw.agg(F.abs(F.count(F.lit(1)) - F.lit(recorded)).alias("record_count_difference")), ["record_count_difference"])


def descriptions_only(raw: DataFrame, keys: Sequence[str], column: str = "desc", outcomes: Sequence[str] = ("loan_status", "target")) -> DataFrame:
    """Keys and one text column; the outcome columns never reach the plan's output."""
    out = raw.select(*keys, column)
    if leaked := set(outcomes) & set(out.columns):
        raise ContractError(f"outcome columns in a description scan: {sorted(leaked)}")
    return out


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or Parquet score file by suffix. The id is read as text, so leading zeros stay; other CSV columns get inferred types."""
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path).withColumn("loan_id", F.col("loan_id").cast("string"))
    inferred = spark.read.csv(path, header=True, inferSchema=True).schema
    typed = StructType([StructField(f.name, StringType() if f.name == "loan_id" else f.dataType) for f in inferred])
    return spark.read.csv(path, header=True, schema=typed)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artifact or statistics record under an explicit schema."""
    return spark.read.json(path, schema=schema, multiLine=True)
