"""Manifests, file checksums and order-free table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.functions.sampling import concat_key

SHA256_PATTERN = r"^[0-9a-f]{64}$"


def role_manifest(written: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Rows and month range per role, read from the written table, with the versions it belongs to."""
    return written.groupBy("role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("issue_month").alias("first_month"), F.max("issue_month").alias("last_month"),
    ).select("*", *[F.lit(v).alias(k) for k, v in versions.items()])


def file_checksums(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, length, sha256) of whole files of at most 2 GB each; larger inputs use ``fingerprint``."""
    return spark.read.format("binaryFile").load(list(paths)).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Row count, sum (as text) and xor of 60-bit row digests: equal tables agree whatever their order or partitions."""
    digest = F.conv(F.substring(F.md5(concat_key([F.col(c) for c in columns])), 1, 15), 16, 10).cast("long")
    hashed = df.select(*by, digest.alias("_h"))
    return hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("_h").cast("decimal(20,0)")).cast("string").alias("digest_sum"), F.bit_xor("_h").alias("digest_xor"))


def exact_id_digest(ids: DataFrame, key: str = "loan_id", max_rows: int = 500_000) -> str:
    """SHA-256 of the sorted, newline-joined ids of a small set; a larger set is refused."""
    if ids.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} ids: use fingerprint")
    return ids.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(key))), 256)).first()[0]


def compare_checksums(recorded: DataFrame, current: DataFrame, path: str = "path", value: str = "sha256") -> DataFrame:
    """Per path: present on both sides, pinned, and equal."""
    a = recorded.select(path, F.col(value).alias("recorded"), F.lit(True).alias("_r"))
    b = current.select(path, F.col(value).alias("current"), F.lit(True).alias("_c"))
    state = (
        F.when(F.col("_r").isNull(), "not recorded").when(F.col("_c").isNull(), "not found")
        .when(F.col("recorded").isNull(), "no pin").when(F.col("recorded") == F.col("current"), "equal").otherwise("changed"))
    return a.join(b, path, "full_outer").select(path, state.alias("state"), (state == "equal").alias("passed"))


def output_record(table: DataFrame, name: str, key: Sequence[str], version_column: str) -> DataFrame:
    """One manifest row per version of a written table: rows, columns and fingerprint."""
    return fingerprint(table, key, [version_column]).select(
        F.lit(name).alias("table"), F.col(version_column).alias("model_version"), "rows", F.lit(",".join(table.columns)).alias("columns"), "digest_sum", "digest_xor")
