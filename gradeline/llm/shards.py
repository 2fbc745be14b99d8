"""Contiguous shards of near-equal bytes, from global prefix sums of row sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.ranks import in_order
from gradeline.session import checkpointed

ROW_BYTES = 16


def shards(docs: DataFrame, count: int = 40, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the ``carry`` columns for every row of ``docs`` (doc_id, text).

    Rows stand in the order of doc_id (null first), then checksum and size. A row's size is its UTF-8 bytes plus 16; the sum of
    all sizes before it, built from per-range totals, puts the row's middle into one of ``count`` equal stretches. So a shard
    is one stretch of the order, and its bytes miss the target by less than one row at either end; a row larger than the target
    fills its shard alone and may leave neighbours empty. Null texts count 16 bytes. Repeated rows keep separate slots. Empty
    input gives an empty table. Only the carried columns of ``docs`` reach a shuffle, beside ids and sizes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = checkpointed(docs.select(
        "doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *carry))
    total = rows.agg(F.sum("size")).first()[0] or 1
    placed = in_order(rows, ["doc_id", "text_crc32", "size"], "size")
    middle = F.col("before") * 2 + F.col("size")
    placed = placed.withColumn("shard", F.least(F.floor(middle / F.lit(2 * total) * count), F.lit(count - 1)).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", *carry, "shard", (F.col("position") - F.col("first")).alias("slot"))
