"""Line dedup by winnowing over line hashes: later copies of repeated runs of lines go. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 25


def _entries(text: Column) -> Column:
    """Line number, two hashes and word count of every line that has a word; lines compare without spaces at their ends."""
    def entry(line: Column, i: Column) -> Column:
        body = F.btrim(line, F.lit(" \t\r\v\f"))
        return F.struct(i.alias("i"), F.xxhash64(body).alias("h"), F.xxhash64(F.lit(1), body).alias("g"),
                        F.regexp_count(body, F.lit(WORD)).alias("w"))

    return F.filter(F.transform(F.split(text, "\n"), entry), lambda e: e["w"] > 0)


def _windows(min_words: int) -> Column:
    """The shortest runs of at least ``min_words`` words that start at a line, and those that end at one, over column ``entries``."""
    n = F.size("entries")

    def reach(lines: Column) -> Column:
        """How many of the lines it takes, and their words."""
        grown = lambda acc, e: F.when(acc["s"] >= min_words, acc).otherwise(
            F.struct((acc["s"] + e["w"]).alias("s"), (acc["k"] + 1).alias("k")))
        return F.aggregate(lines, F.struct(F.lit(0).alias("s"), F.lit(0).alias("k")), grown)

    def run(start: Column, count: Column) -> Column:
        lines = F.slice("entries", start + 1, count)
        # The least hash of the window, its last occurrence in it: the line that stands for the window.
        mark = F.array_min(F.transform(lines, lambda e: F.struct(e["h"].alias("h"), (-e["i"]).alias("i"))))
        hashes = lambda c: F.transform(lines, lambda e: e[c])
        return F.struct(lines[0]["i"].alias("start"), F.element_at(lines, -1)["i"].alias("stop"), mark["h"].alias("mark"),
                        F.xxhash64(hashes("h")).alias("d"), F.xxhash64(hashes("g")).alias("e"))

    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    onward = F.transform(places, lambda a: F.struct(a.alias("a"), reach(F.slice("entries", a + 1, F.lit(min_words))).alias("r")))
    # First line and count in one long: arrays of longs are united by hashing, arrays of structs by comparing all with all.
    onward = F.transform(F.filter(onward, lambda x: x["r"]["s"] >= min_words), lambda x: _packed(x["a"], x["r"]["k"]))
    low = lambda b: F.greatest(b - (min_words - 1), F.lit(0))
    back = F.transform(places, lambda b: F.struct(
        b.alias("b"), reach(F.reverse(F.slice("entries", low(b) + 1, b - low(b) + 1))).alias("r")))
    back = F.transform(F.filter(back, lambda x: x["r"]["s"] >= min_words), lambda x: _packed(x["b"] - x["r"]["k"] + 1, x["r"]["k"]))
    return F.transform(F.array_union(onward, back), lambda x: run((F.shiftright(x, 32)).cast("int"), x.bitwiseAND(0xFFFFFFFF).cast("int")))


def _packed(start: Column, count: Column) -> Column:
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(count.cast("long"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key and ``runs``, an array of (start, stop) line numbers: lines that repeat an earlier run. See ``dedup_lines``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = checkpointed(docs.select("doc_id", F.xxhash64(text).alias("text_key"), _entries(text).alias("entries")))
    windows = hashed.select("doc_id", "text_key", F.explode(_windows(min_words)).alias("w")).select("doc_id", "text_key", "w.*")
    # Winnowing: only windows whose mark stands for a window elsewhere, too, can repeat.
    marks = windows.groupBy("mark").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "start", "stop")).alias("a"),
        F.max(F.struct("doc_id", "text_key", "start", "stop")).alias("b")).where("n > 1 and a <> b").select("mark")
    matched = checkpointed(windows.join(marks, "mark").drop("mark"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "start", "stop")).alias("first")
    firsts = matched.groupBy("d", "e").agg(first, F.count(F.lit(1)).alias("copies")).where("copies > 1")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    later = matched.join(firsts.select("d", "e", "first"), ["d", "e"]).where(~same | (F.col("start") > F.col("first.stop")))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with later repeated runs taken out of ``text``, plus ``lines`` and ``lines_removed``.

    A run of whole lines with at least ``min_words`` words goes from a text when the same run stands earlier: in a document of smaller
    (doc_id, text hash; null last), or before it in the same one without overlap. Windows are the shortest runs of ``min_words``
    words that start or end at a line; all whose least line hash stands for another window, too, are matched in full with the first
    window of equal lines, and the union of the matched windows takes the place of growing matches, so no run of at least
    ``min_words`` words is missed and shorter ones stay. So does a repeated passage inside a longer line that differs. Lines compare without spaces at their ends; lines without a word take no part, but go when they lie inside a
    run. Rows equal in doc_id and text are one document: both keep or lose the same lines. Null stays null, empty texts stay
    empty, columns of the same names as the two counts are replaced, empty input gives an empty table.
    """
    others = [c for c in docs.columns if c not in ("lines", "lines_removed")]
    runs = repeated_runs(docs.select("doc_id", "text"), min_words)
    keyed = docs.select(*others).withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    hits = runs.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key_of"), F.col("runs").alias("__runs"))
    joined = keyed.join(hits, (F.col("__key") == F.col("__key_of")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = F.split("text", "\n")
    gone = F.array_distinct(F.flatten(F.transform("__runs", lambda r: F.sequence(r["start"], r["stop"]))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # The struct binds the lines to one value: inside a lambda, the split would run again for every line.
    bound = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))
    cut = F.transform(bound, lambda b: F.array_join(F.transform(b["kept"], lambda i: b["lines"][i]), "\n"))[0]
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    removed = F.when(F.col("__runs").isNull(), 0).otherwise(F.size(gone))
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(cut).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"`{c}`") for c in others],
                         count.cast("long").alias("lines"), removed.cast("long").alias("lines_removed"))
