"""Exact duplicates by block naming: equal blocks get equal integer names, then equal pairs of names, up to one name a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.ranks import in_order
from gradeline.session import checkpointed

SPACES = r"[\x20\x09-\x0D]+"


RANGE_BYTES = 32 << 20


def named(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The distinct values of ``keys`` (at most ``width`` bytes) in sorted order, each with its position as ``name``; a range of the
    order holds at most about ``RANGE_BYTES``."""
    ordered = in_order(checkpointed(rows.select(*keys).distinct()), keys, rows_per_range=max(1, RANGE_BYTES // (width + 16)))
    return ordered.withColumnRenamed("position", "name")


def block_names(parts: DataFrame, block: int = 2048) -> DataFrame:
    """uid, level, name for a table (uid, body binary): two rows have one (level, name) if and only if their bodies are equal.

    Level 0 names the sorted distinct blocks of ``block`` bytes; each further level names the sorted distinct pairs of
    neighbours (an odd last one is paired with -1), until one name is left. Equal bodies have equally many blocks and so end on
    one level; by induction over the levels equal names stand for equal bytes, without any hash. The number of levels is the
    logarithm of the longest body in blocks; texts leave as soon as they are done. An empty body is one empty block.
    """
    size = F.greatest(F.ceil(F.octet_length("body") / block), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.substring(F.col("body"), i * block + 1, F.lit(block)))
    rows = parts.withColumn("count", size).select("uid", "count", F.posexplode(cut).alias("i", "part"))
    rows = checkpointed(rows.join(named(rows, ["part"], block), "part").select("uid", "count", "i", "name"))
    done, level = None, 0
    while True:
        ready = rows.where("count = 1").select("uid", F.lit(level).alias("level"), "name")
        done = ready if done is None else done.unionByName(ready)
        rows = rows.where("count > 1")
        if rows.isEmpty():
            return done
        level += 1
        half = F.floor(F.col("i") / 2).cast("int").alias("i")
        side = lambda k: F.max(F.when(F.col("i") % 2 == k, F.col("name")))
        pairs = checkpointed(rows.groupBy("uid", "count", half).agg(
            side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right")))
        rows = checkpointed(pairs.join(named(pairs, ["left", "right"], 16), ["left", "right"]).select(
            "uid", F.ceil(F.col("count") / 2).cast("int").alias("count"), "i", "name"))


def exact_groups(docs: DataFrame, block: int = 2048) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts count as equal when they are identical without white space; null counts as empty. A text whose (length, hash) stands
    alone equals no other, so only the rest is named block by block, and the names alone decide. Of a group the row with the
    most code points stays, then the smallest doc_id (null last); of rows equal in all that exactly one. Empty input gives an
    empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.length(text).cast("long").alias("points"), F.regexp_replace(text, SPACES, "").alias("norm"))
    base = base.select("*", F.octet_length("norm").alias("bytes"), F.xxhash64("norm").alias("hash"))
    rows = checkpointed(base.select("doc_id", "points", "bytes", "hash", F.sha2("norm", 256).alias("text_sha256")))
    counts = rows.groupBy("bytes", "hash").agg(F.count(F.lit(1)).alias("n"))
    shared, alone = counts.where("n > 1").select("bytes", "hash"), counts.where("n = 1").select("bytes", "hash")
    singles = rows.join(alone, ["bytes", "hash"]).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    wanted = checkpointed(base.join(shared, ["bytes", "hash"]).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "points", F.col("norm").cast("binary").alias("body"),
        F.sha2("norm", 256).alias("text_sha256")))
    identity = block_names(wanted.select("uid", "body"), block)
    members = wanted.select("uid", "doc_id", "points", "text_sha256").join(identity, "uid")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "uid"))
    groups = members.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    copies = members.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256")
    return singles.unionByName(copies)
