"""Sinks that verify what they wrote, and refuse to overwrite what is frozen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.operators.checks import check_rows, coverage_checks, enforce
from gradeline.functions.columns import differs


def written_checks(written: DataFrame, source: DataFrame, key: str, values: Sequence[str], atol: float = 0.0) -> DataFrame:
    """Key coverage and value equality of a written table against its source, by key."""
    other = source.select(key, *[F.col(v).alias(f"_s_{v}") for v in values])
    joined = written.select(key, *values).join(other, key)
    sums = joined.agg(*[F.count_if(differs(F.col(v), F.col(f"_s_{v}"), atol) & ~(F.col(v).isNull() & F.col(f"_s_{v}").isNull())).alias(f"differs_{v}") for v in values])
    return coverage_checks(written, source, [key]).unionByName(check_rows(sums, [f"differs_{v}" for v in values]))


def write_verified(df: DataFrame, path: str, key: str, values: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Write Parquet to a new location (an existing one is refused), read it back and compare."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    written = df.sparkSession.read.parquet(path)
    enforce(written_checks(written, df, key, values), path)
    return written


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_verified(df: DataFrame, path: str, key: str, values: Sequence[str], version: str) -> DataFrame:
    """Write to a staging folder, verify, then swap it in; the old table is kept aside until the new one stands, and put back if it can't."""
    spark = df.sparkSession
    staging = path.rstrip("/") + "._staging"
    stage_path, fs = _file_system(spark, staging)
    target_path, _ = _file_system(spark, path)
    fs.delete(stage_path, True)
    write_verified(df.withColumn("feature_version", F.lit(version)), staging, key, values)
    old_path, _ = _file_system(spark, path.rstrip("/") + "._old")
    fs.delete(old_path, True)
    replaced = fs.exists(target_path)
    if replaced and not fs.rename(target_path, old_path):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(stage_path, target_path):
        if replaced:
            fs.rename(old_path, target_path)
        raise OSError(f"could not move {staging} to {path}")
    fs.delete(old_path, True)
    return spark.read.parquet(path)


def write_summary_csv(df: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """A bounded summary table as one CSV file; a larger table belongs in Parquet."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows: write this table as Parquet")
    df.coalesce(1).write.mode("errorifexists").csv(path, header=True)


def write_handoff(tables: dict[str, DataFrame], checks: dict[str, DataFrame], path: str) -> DataFrame:
    """Every table version, partitioned by version and role; nothing is written unless all checks pass."""
    for name, rows in checks.items():
        enforce(rows, name)
    spark = None
    for version, table in tables.items():
        spark = table.sparkSession
        table.write.mode("errorifexists").partitionBy("role").parquet(f"{path}/table_version={version}")
    return spark.read.option("mergeSchema", True).parquet(path)


def write_artifact(table: DataFrame, path: str) -> None:
    """A one-row artifact table as JSON."""
    table.coalesce(1).write.mode("errorifexists").json(path)
