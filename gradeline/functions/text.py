"""Text Column functions: payloads, word tokens, readability and keyword density.

Everything stays in the JVM but NFKC and character references, which go through Arrow for the rows that hold any.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from gradeline.functions.columns import MISSING_MARKERS, ratio, squeeze, strip

# The UDFs travel to the executors by value, so the workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Field labels of the payload, keywords, and the word, sentence and wrapper patterns.
FIELD_LABELS = {"title": "Title", "purpose": "Purpose", "desc": "Description", "emp_title": "Employment title"}
DISTRESS_KEYWORDS = ("arrears", "bankruptcy", "behind", "delinquent", "emergency", "eviction", "foreclosure", "medical",
                     "overdue", "payday", "unemployed")
_LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD_PATTERN = _LETTER + r"+(?:['-]" + _LETTER + r"+)*"
SENTENCE_PATTERN = r"[.!?]+|\n+"
TERM_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
ITEM_PATTERN = r"[^\s\p{Z}\x0b\x1c-\x1f\x85]+"
WRAPPER_PATTERN = r"(?iU)\bBorrower\s+added\s+on\s+\d{1,2}/\d{1,2}/\d{2,4}\s*>\s*"
TAG_PATTERN = r"</?[A-Za-z][^>]*>"
ENTITY_PATTERN = r"&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);"


# What a browser does not show: bodies of scripts and styles, comments and declarations; then tags, each a word border.
SILENT_PATTERN = r"(?is)<(script|style)(?:\s[^>]*)?>.*?(?:</\1\s*>|\z)"
COMMENT_PATTERN = r"(?s)<!--.*?-->|<![A-Za-z\[][^>]*>|<\?[^>]*>"


# A tag ends at the first ">" outside quoted values; with an unclosed quote, at the first one.
MARKUP_PATTERN = r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|""" + TAG_PATTERN
_REMOVED = ((SILENT_PATTERN, " "), (COMMENT_PATTERN, ""), (MARKUP_PATTERN, " "))


_TEXTS_AT_ONCE = 64


@F.arrow_udf(StringType())
def cleaned_markup(values: pa.Array) -> pa.Array:
    """NFKC, references decoded, markup removed, references decoded once more, NFKC: one pass for the texts that need Python at all.

    A batch holds thousands of pages: beside its Arrow bytes only a few texts at a time are Python strings.
    """
    patterns = [(re.compile(p.replace(r"\z", r"\Z")), put) for p, put in _REMOVED]

    def clean(text: str) -> str:
        text = html.unescape(unicodedata.normalize("NFKC", text).strip())
        for pattern, put in patterns:
            text = pattern.sub(put, text)
        return unicodedata.normalize("NFKC", html.unescape(text))

    parts = (values.slice(at, _TEXTS_AT_ONCE).to_pylist() for at in range(0, len(values), _TEXTS_AT_ONCE))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([v and clean(v) for v in part], pa.string()) for part in parts)])


def clean_markup(value: Column) -> Column:
    """NFKC text without markup; a missing value or marker is the empty string.

    References are decoded before the markup goes (exported fields hold escaped tags) and once more in what is shown. Texts of plain
    ASCII without a reference stay in the JVM, where the same patterns give the same text.
    """
    text = strip(F.coalesce(value, F.lit("")))
    shown = text
    for pattern, put in _REMOVED:
        shown = F.regexp_replace(shown, pattern, put)
    shown = F.coalesce(cleaned_markup(F.when(text.rlike(r"[^\x00-\x7F]|&"), text)), shown)
    return F.when(text.isNull() | F.lower(text).isin(*MISSING_MARKERS), "").otherwise(F.coalesce(shown, F.lit("")))


@F.pandas_udf(BooleanType())
def nfkc_changes(values: pd.Series) -> pd.Series:
    return values.map(lambda v: bool(v) and unicodedata.normalize("NFKC", v) != v)


def finish_clean(text: Column) -> Column:
    """Wrapper prefixes, control and format characters, white space and missing markers."""
    out = F.regexp_replace(text, WRAPPER_PATTERN, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\p{Cf}", ""), r"\p{Cc}", " ")
    out = squeeze(out)
    return F.when(F.lower(out).isin(*MISSING_MARKERS), "").otherwise(out)


def clean_text(value: Column) -> Column:
    """The shared text cleaner."""
    return finish_clean(clean_markup(value))


def category_words(value: Column) -> Column:
    return squeeze(F.translate(value, "_", " "))


def payload(fields: Mapping[str, Column]) -> Column:
    """Labelled lines of the non-empty cleaned fields, in the order given."""
    lines = []
    for name, value in fields.items():
        text = category_words(value) if name == "purpose" else value
        lines.append(F.when(text != "", F.concat(F.lit(f"{FIELD_LABELS[name]}: "), text)))
    return F.concat_ws("\n", *lines)


def strip_labels(text: Column) -> Column:
    labels = "|".join(FIELD_LABELS.values())
    return strip(F.regexp_replace(text, f"(?m)^(?:{labels}): ", ""))


def fold_case(text: Column) -> Column:
    """Lower case with the sharp s expanded and the typographic apostrophe made plain."""
    return F.translate(F.regexp_replace(F.lower(text), "ß", "ss"), "’", "'")


def words(text: Column) -> Column:
    """Word tokens: letters with inner apostrophes or hyphens, no digits."""
    return F.regexp_extract_all(fold_case(text), F.lit(WORD_PATTERN), F.lit(0))


def item_count(text: Column) -> Column:
    """White-space separated items."""
    return F.regexp_count(text, F.lit(ITEM_PATTERN))


def sentence_count(text: Column, word_count: Column) -> Column:
    spans = F.size(F.filter(F.split(text, SENTENCE_PATTERN), lambda s: s.rlike(_LETTER)))
    return F.when(word_count == 0, 0).otherwise(F.greatest(F.lit(1), spans))


def _accent_table() -> tuple[str, str]:
    """Latin letters whose compatibility form is one ASCII letter, by rule over the Latin blocks."""
    plain = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(base) == 1 and base.isalpha():
            plain[chr(point)] = base.lower()
    return "".join(plain), "".join(plain.values())


_ACCENTED, _PLAIN = _accent_table()


def ascii_letters(word: Column) -> Column:
    return F.regexp_replace(F.translate(word, _ACCENTED, _PLAIN), "[^a-z]", "")


def syllables(word: Column) -> Column:
    """Vowel groups with the silent-e and consonant-le rules; short words count one."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = F.when(word.rlike("e$") & ~word.rlike("[ly]e$"), 1).otherwise(0)
    extra = F.when(word.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), groups - silent + extra))


def total_syllables(tokens: Column) -> Column:
    """Sum of ``syllables`` over the tokens, counted on the joined text in a few regex passes.

    Words of up to three letters count one. A longer word whose vowel groups cancel against its
    silent e (or that has none) is raised to one by the last two counts.
    """
    text = F.regexp_replace(F.translate(F.array_join(tokens, " "), _ACCENTED, _PLAIN), "[^a-z ]", "")
    long = F.array_join(F.regexp_extract_all(text, F.lit("[a-z]{4,}"), F.lit(0)), " ")
    count = lambda pattern: F.regexp_count(long, F.lit(pattern))
    long_words = count("[a-z]+")
    without_vowel = count(r"\b[^aeiouy ]+\b")
    only_silent = count(r"\b[^aeiouy ]*[aeiouy]*(?<![ly])e\b")
    return (F.size(tokens) - long_words) + count("[aeiouy]+") - count(r"(?<![ly])e\b") + count(r"[^aeiouy ]le\b") + without_vowel + only_silent


def hits(tokens: Column, keywords: Sequence[str] = DISTRESS_KEYWORDS) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*keywords)))


def density(tokens: Column, keywords: Sequence[str] = DISTRESS_KEYWORDS) -> Column:
    return ratio(hits(tokens, keywords), F.size(tokens), 0.0)


def lexical_features(rows: DataFrame, text: str, keywords: Sequence[str] = DISTRESS_KEYWORDS) -> DataFrame:
    """Adds readability, type-token ratio and keyword density; all 0.0 for a text without words.

    The counts are made once in their own projection, then only arithmetic is left.
    """
    tokens = rows.withColumn("_w", words(F.col(text)))
    counts = tokens.select(
        *rows.columns, F.size("_w").alias("_n"), sentence_count(F.col(text), F.size("_w")).alias("_s"),
        total_syllables(F.col("_w")).alias("_y"), F.size(F.array_distinct("_w")).alias("_d"), hits(F.col("_w"), keywords).alias("_h"))
    count = F.col("_n")
    per_sentence, per_word = count / F.col("_s"), F.col("_y") / count
    some = lambda value: F.when(count > 0, value).otherwise(F.lit(0.0))
    return counts.select(
        *rows.columns,
        some(F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * per_word).alias("flesch_reading_ease"),
        some(F.lit(0.39) * per_sentence + F.lit(11.8) * per_word - F.lit(15.59)).alias("flesch_kincaid_grade"),
        some(F.col("_d") / count).alias("lexical_diversity_ttr"),
        some(F.col("_h") / count).alias("financial_distress_keyword_density"))
