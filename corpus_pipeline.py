"""A corpus pipeline over documents: toxicity, line dedup, near dedup, secret scans, packing; each stage reads what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm import lines, minhash, packing, secrets, toxicity
from gradeline.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]"
MASK = "[secret]"


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and ``n_chars`` to match where the column is there."""
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic; it learns from labelled rows of ``docs``. Null and empty texts stay
    unless the intercept alone says otherwise."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; a document of which no word is left goes, one that never had words stays."""
    done = lines.dedup_lines(docs.select(*docs.columns))
    left = (F.col("lines_removed") == 0) | F.col("text").rlike(WORD)
    return _with_text(done.where(left), F.col("text")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group over five-word shingles, the one of smallest doc_id; empty ones stay."""
    return minhash.without_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span of their texts masked."""
    done = secrets.masked(docs, MASK)
    return _with_text(done, F.col("text")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 2,048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: The trained classifier, the tokenizer and the forest of links have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
