"""N-gram tables: vocabularies, TF-IDF weights, coverage, volatility and term contributions."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeline.functions.columns import ratio
from gradeline.functions.text import TERM_TOKEN_PATTERN
from gradeline.operators.ordering import attach

# The counting functions travel to the executors by value, so the workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def default_stop_words() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def term_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-case tokens of two or more word characters, stop words removed before any n-gram."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TERM_TOKEN_PATTERN), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(*stop_words)) if stop_words else tokens


def ngrams(tokens: str, low: int, high: int) -> Column:
    """All n-grams from ``low`` to ``high`` words of a token column, joined by one space."""

    def exactly(n: int) -> Column:
        if n == 1:
            return F.col(tokens)
        starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(F.col(tokens), i, n), " "))
        return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))

    parts = [exactly(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


_TERMS_PER_BATCH = 200_000
_LISTS = "terms array<string>, tfs array<bigint>"


def _grams(text: str, stop_words: frozenset, low: int, high: int, distinct: bool) -> dict:
    """Counts of the n-grams of a text of words and single spaces; with ``distinct`` each counts once."""
    words = [w for w in text.split(" ") if len(w) > 1 and w not in stop_words]
    counts: Counter = Counter()
    for n in range(low, high + 1):
        counts.update(words if n == 1 else map(" ".join, zip(*(words[k:] for k in range(n)))))
    return dict.fromkeys(counts, 1) if distinct else counts


def _counted(fields: Sequence[str], kept: Sequence[str], stop_words: frozenset, low: int, high: int, wanted: frozenset | None, distinct: bool):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(batch: pa.RecordBatch, first: int, ends: list, terms: list, tfs: list) -> pa.RecordBatch:
            part, offsets = batch.slice(first, len(ends)), pa.array([0, *ends], pa.int32())
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())),
                                               pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=[*kept, "terms", "tfs"])

        for batch in batches:
            first, ends, terms, tfs = 0, [], [], []
            columns = [batch.column(f) for f in fields]
            for row in range(batch.num_rows):
                for column in columns:
                    found = _grams(column[row].as_py() or "", stop_words, low, high, distinct)
                    if wanted is not None:
                        found = {t: n for t, n in found.items() if t in wanted}
                    terms += found.keys()
                    tfs += found.values()
                ends.append(len(terms))
                if len(terms) >= _TERMS_PER_BATCH:
                    yield packed(batch, first, ends, terms, tfs)
                    first, ends, terms, tfs = row + 1, [], [], []
            if ends:
                yield packed(batch, first, ends, terms, tfs)

    return count


def _words(text: Column) -> Column:
    """Runs of word characters of the lower-case text, one space between them."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")


def term_lists(docs: DataFrame, fields: Sequence[str], stop_words: Sequence[str], ngram_range: tuple[int, int] = (1, 1), keep: Sequence[str] = (),
               wanted: frozenset | None = None, distinct: bool = False, counted: bool = True) -> DataFrame:
    """(keep..., terms, tfs): one row a document with its distinct terms and their counts, field after field.

    The JVM finds the word characters, tasks count in Arrow batches. ``wanted`` bounds the terms, ``distinct`` counts each once a field.
    Not ``counted``, the rows of a single field are (keep..., words), and whoever reads the words counts their n-grams (``Words``).
    """
    if not counted:
        text = F.col(*fields)
        plain = F.length(text) == F.octet_length(text)  # ASCII texts are cut by ``Words``
        return docs.select(*keep, F.when(plain, text).otherwise(_words(text)).alias("words", metadata={"stop_words": [*stop_words]}))
    at = [f"_f{k}" for k in range(len(fields))]
    rows = docs.select(*keep, *[_words(F.col(f)).alias(name) for f, name in zip(fields, at, strict=True)])
    schema = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL(_LISTS).fields])
    return rows.mapInArrow(_counted(at, list(keep), frozenset(stop_words), *ngram_range, wanted, distinct), schema)


def _plain_words(data: pa.Buffer | None) -> np.ndarray:
    """The bytes of texts with ASCII letters in lower case and spaces for all other ASCII that is no word character."""
    table = np.arange(256, dtype=np.uint8)
    table[[k for k in range(128) if not (chr(k).isalnum() or chr(k) == "_")]] = ord(" ")
    table[ord("A"):ord("Z") + 1] += 32
    return table[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)


class Words:
    """Some texts as numbers of their words, stop words and single characters left out; n-grams are counted from them by sorting."""

    def __init__(self, texts: int, words: pa.Array, owner: np.ndarray, numbers: np.ndarray):
        self.texts, self.words, self.owner, self.numbers = texts, words, owner, numbers

    @staticmethod
    def of(texts: pa.Array, stop_words: frozenset) -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
        """Number of texts, distinct words, and text and number of every word that stands: plain data, as blocks of documents hold it."""
        texts = texts.fill_null("")
        parts = pc.split_pattern(pa.StringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(_plain_words(texts.buffers()[2])), offset=texts.offset), " ")
        found = parts.flatten().dictionary_encode()
        words, numbers = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
        kept = pc.greater(pc.utf8_length(words), 1).to_numpy(zero_copy_only=False)
        kept &= ~pc.is_in(words, value_set=pa.array(sorted(stop_words), pa.string())).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), parts.value_lengths().to_numpy(zero_copy_only=False))
        inside = kept[numbers]
        return len(texts), words.filter(pa.array(kept)), owner[inside], (np.cumsum(kept) - 1)[numbers[inside]].astype(np.int32)

    def grams(self, high: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """For every length up to ``high``: the distinct n-grams, and (text, number of the n-gram, count) of their occurrences."""
        size, place, names = max(1, len(self.words)), self.numbers.astype(np.int64), self.words
        for n in range(1, high + 1):
            owner = self.owner[n - 1:]
            if n > 1:  # an n-gram is one of a word less and the word after it
                together = np.flatnonzero(owner == self.owner[:len(owner)])
                codes = np.full(len(owner), -1, np.int64)
                codes[together] = place[together] * size + self.numbers[n - 1:][together]
                own, place = np.unique(codes, return_inverse=True)
                first = int(len(own) > 0 and own[0] < 0)
                own, place = own[first:], place - first
                names = pc.binary_join_element_wise(names.take(pa.array(own // size)), self.words.take(pa.array(own % size)), " ")
            held = np.flatnonzero(place >= 0)
            found, counts = np.unique(place[held] * self.texts + owner[held], return_counts=True)
            yield names, found % self.texts, found // self.texts, counts
            place = place[:-1]

    def known(self, index: TermIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number, count) of the terms that ``index`` numbers."""
        base = max(1, len(index.words))
        word = pc.index_in(self.words, value_set=index.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[self.numbers]
        held, place, found = np.flatnonzero(word >= 0), word[word >= 0], []
        for n, (codes, numbers) in enumerate(index.levels, 1):
            if n > 1:
                last = held + (n - 1)
                inside = last < len(word)
                held, place, last = held[inside], place[inside], last[inside]
                inside = (word[last] >= 0) & (self.owner[last] == self.owner[held])
                held, code = held[inside], place[inside] * base + word[last[inside]]
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                inside = codes[place] == code
                held, place = held[inside], place[inside]
            named = numbers[place] >= 0
            found.append(numbers[place[named]] * max(1, self.texts) + self.owner[held[named]])
        found, counts = np.unique(np.concatenate(found), return_counts=True)
        return found % max(1, self.texts), found // max(1, self.texts), counts


class TermIndex(NamedTuple):
    """Numbers of some n-grams, looked up word after word: a level holds the starts of that many words and the number of each that is a term."""

    terms: pa.Array
    words: pa.Array
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, terms: Sequence[str]) -> TermIndex:
        split = [t.split(" ") for t in terms]
        words = sorted({w for t in split for w in t})
        place = {w: k for k, w in enumerate(words)}
        numbers = np.full(len(words), -1, np.int64)
        for k, t in enumerate(split):
            if len(t) == 1:
                numbers[place[t[0]]] = k
        levels = [(np.arange(len(words)), numbers)]
        start = {k: place[t[0]] for k, t in enumerate(split)}
        for n in range(2, max(map(len, split), default=1) + 1):
            code = {k: start[k] * len(words) + place[split[k][n - 1]] for k in start if len(split[k]) >= n}
            codes = np.array(sorted(set(code.values())), np.int64)
            at = dict(zip(codes.tolist(), range(len(codes)), strict=True))
            start = {k: at[c] for k, c in code.items()}
            numbers = np.full(len(codes), -1, np.int64)
            for k, p in start.items():
                if len(split[k]) == n:
                    numbers[p] = k
            levels.append((codes, numbers))
        return cls(pa.array(terms, pa.string()), pa.array(words, pa.string()), levels)


def listed(counts: DataFrame, key: str) -> DataFrame:
    """One row a document (key, terms, tfs) of a count table (key, term, tf); lists stay what they are."""
    return counts if "terms" in counts.columns else counts.groupBy(key).agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))


def unlisted(lists: DataFrame) -> DataFrame:
    """One row (..., term, tf) for every term of the lists."""
    kept = [c for c in lists.columns if c not in ("terms", "tfs")]
    return lists.select(*kept, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))


def term_counts(docs: DataFrame, text: str, stop_words: Sequence[str], ngram_range: tuple[int, int] = (1, 1),
                key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep..., term, tf), counted inside each row: neither a text nor a token is shuffled. A row is a document."""
    return unlisted(term_lists(docs, [text], stop_words, ngram_range, [key, *keep]))


def vocabulary(counts: DataFrame, docs: DataFrame, max_features: int) -> DataFrame:
    """Top terms by corpus count (ties by term) with document frequency and smoothed idf.

    At most ``max_features`` rows, so it may be broadcast.
    """
    totals = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    top = totals.orderBy(F.col("total").desc(), "term").limit(max_features)
    top = attach(top, docs.agg(F.count(F.lit(1)).alias("_docs")), [])
    return top.select("term", "total", "df", (F.ln((1 + F.col("_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame, sublinear: bool = True, key: str = "doc_id") -> DataFrame:
    """L2-normalised weights (key, term, weight) over a bounded vocabulary."""
    tf = F.ln("tf") + 1 if sublinear else F.col("tf").cast("double")
    raw = counts.join(F.broadcast(vocab), "term").withColumn("_w", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    extra = [c for c in ("position",) if c in vocab.columns]
    return raw.select(key, "term", *extra, (F.col("_w") / norm).alias("weight"))


def document_frequency(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("documents"))


def coverage(counts: DataFrame, vocab: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of n-gram occurrences the vocabulary covers, per kind of n-gram."""
    kind = F.when(F.instr("term", " ") > 0, "bigram").otherwise("unigram")
    known = F.broadcast(vocab.select("term", F.lit(True).alias("_known")))
    return counts.join(known, "term", "left").groupBy(*by, kind.alias("kind")).agg(
        F.sum("tf").alias("occurrences"), F.coalesce(F.sum(F.when(F.col("_known"), F.col("tf"))), F.lit(0)).alias("covered"),
    ).withColumn("covered_percent", F.lit(100.0) * ratio(F.col("covered"), F.col("occurrences"), 0.0))


def empty_rows(docs: DataFrame, counts: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose vector is empty: no term of theirs is in the vocabulary."""
    matched = counts.join(F.broadcast(vocab.select("term")), "term", "left_semi").select(key)
    return docs.join(matched, key, "left_anti")


def within_fields(docs: DataFrame, fields: Sequence[str], terms: DataFrame, stop_words: Sequence[str],
                  ngram_range: tuple[int, int], key: str = "doc_id") -> DataFrame:
    """Document counts of terms measured inside single fields, summed over the fields."""
    wanted = frozenset(r["term"] for r in terms.select("term").collect())  # a ranked list, bounded by its k
    found = unlisted(term_lists(docs, fields, stop_words, ngram_range, wanted=wanted, distinct=True)).groupBy("term").agg(
        F.count(F.lit(1)).alias("within_field_documents"))
    return terms.select("term").join(found, "term", "left").select(
        "term", F.coalesce("within_field_documents", F.lit(0)).alias("within_field_documents"))


def volatility(counts: DataFrame, vocab: DataFrame, terms: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Per-million frequency of each term per bucket: max over min, peak and trough bucket.

    The denominator is every vocabulary occurrence in the bucket. A term absent from a bucket has
    frequency 0 there, and its ratio is infinite.
    """
    inside = counts.join(F.broadcast(vocab.select("term")), "term", "left_semi")
    totals = inside.groupBy(bucket).agg(F.sum("tf").alias("_all"))  # one row per bucket
    wanted = inside.join(F.broadcast(terms.select("term")), "term", "left_semi").groupBy("term", bucket).agg(F.sum("tf").alias("_n"))
    buckets = totals.agg(F.collect_list(F.struct(F.col(bucket).alias("b"), F.col("_all").alias("n"))).alias("_buckets"))
    per_term = wanted.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct(bucket, "_n"))).alias("_seen"))
    rates = attach(per_term, buckets, []).select("term", F.explode(F.transform(
        "_buckets", lambda x: F.struct(x["b"].alias("b"), (F.lit(1e6) * F.coalesce(F.element_at(F.col("_seen"), x["b"]), F.lit(0)) / x["n"]).alias("rate")))).alias("_r"))
    rate, name = F.col("_r.rate"), F.col("_r.b")
    out = rates.groupBy("term").agg(
        F.max(rate).alias("_hi"), F.min(rate).alias("_lo"), F.min(F.struct((-rate).alias("r"), name.alias("b"))).alias("_peak"),
        F.min(F.struct(rate.alias("r"), name.alias("b"))).alias("_trough"))
    return out.select("term", ratio(F.col("_hi"), F.col("_lo"), float("inf")).alias("volatility_ratio"),
                      F.col("_peak.b").alias("peak_bucket"), F.col("_trough.b").alias("trough_bucket"))


def top_terms(coefficients: DataFrame, k: int) -> DataFrame:
    """The k most positive and the k most negative terms (term breaks ties)."""
    high = coefficients.orderBy(F.col("coefficient").desc(), "term").limit(k).withColumn("direction", F.lit("higher_risk"))
    low = coefficients.orderBy("coefficient", "term").limit(k).withColumn("direction", F.lit("lower_risk"))
    return high.unionByName(low)


def flag_terms(ranked: DataFrame, n_docs: Column, floor_percent: float = 1.0, volatility_limit: float = 10.0,
               cross_field_ratio: float = 0.2) -> DataFrame:
    """Artefact flags of ranked terms: rare, spanning two fields, or tied to one period."""
    percent = F.lit(100.0) * F.col("documents") / n_docs
    within = ratio(F.col("within_field_documents"), F.col("documents"))
    flagged = ranked.select(
        "*", percent.alias("document_percent"), within.alias("within_field_ratio"),
        (percent < floor_percent).alias("low_document_frequency"),
        ((F.instr("term", " ") > 0) & (within <= cross_field_ratio)).alias("cross_field_bigram"),
        (F.col("volatility_ratio") > volatility_limit).alias("period_specific"))
    flags = sum((F.col(c).cast("int") for c in ("cross_field_bigram", "period_specific")), F.col("low_document_frequency").cast("int"))
    return flagged.withColumn("artefact_flags", flags).withColumn("retained", F.col("artefact_flags") == 0)


def review_cases(scored: DataFrame, p: str, threshold: float, n_per_error: int, n_extreme: int, draw: Column, key: str = "loan_id") -> DataFrame:
    """Per error type: the strongest n_extreme rows and a seeded draw from the rest.

    Four ordered limits; no window ever sorts a whole error type in one task.
    """
    parts = []
    for name, target, wrong, order in (
        ("false_positive", 0, F.col(p) >= threshold, F.col(p).desc()), ("false_negative", 1, F.col(p) < threshold, F.col(p).asc())):
        rows = scored.filter((F.col("target") == target) & wrong).withColumn("error_type", F.lit(name))
        strongest = rows.orderBy(order, key).limit(n_extreme)
        rest = rows.join(F.broadcast(strongest.select(key)), key, "left_anti")
        parts.append(strongest.withColumn("sample_group", F.lit("strongest")))
        parts.append(rest.withColumn("_u", draw).orderBy("_u", key).limit(n_per_error - n_extreme).drop("_u").withColumn("sample_group", F.lit("random")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contributions(cases: DataFrame, weights: DataFrame, coefficients: DataFrame, terms_per_case: int, min_documents: int,
                  key: str = "doc_id") -> DataFrame:
    """Leading n-grams of each error type: how many cases they lead in and their mean contribution.

    ``coefficients`` is a bounded vocabulary table (term, coefficient, documents).
    """
    scored = cases.select(key, "error_type").join(weights, key).join(
        F.broadcast(coefficients.filter(F.col("documents") >= min_documents)), "term").withColumn("_c", F.col("weight") * F.col("coefficient"))
    sided = scored.filter(F.when(F.col("error_type") == "false_positive", F.col("_c") > 0).otherwise(F.col("_c") < 0))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("_c").desc(), "term"))
    leading = sided.withColumn("_k", place).filter(F.col("_k") <= terms_per_case)
    return leading.groupBy("error_type", F.col("term").alias("ngram")).agg(
        F.count(F.lit(1)).alias("case_count"), F.avg("_c").alias("mean_log_odds_contribution"), F.max("documents").alias("train_document_count"))
