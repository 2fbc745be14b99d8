"""Text cleaning, tokens and readability against small hand-made cases and plain Python."""

import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.functions import columns as C
from gradeline.functions import text as X
from gradeline.operators import lexical, terms


def values(spark, inputs, build):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, t string")
    return [r["o"] for r in df.select("i", build(F.col("t")).alias("o")).orderBy("i").collect()]


CLEAN = {
    None: "", "   ": "", " None ": "", "n/a": "", "NaN": "",
    "  A &amp; B.<br />  No new debt. ": "A & B. No new debt.",
    "Borrower added on 01/01/13 > I do not want more debt.": "I do not want more debt.",
    "borrower  added on 1/2/2013 > Repairs.Borrower added on 01/02/13 > None": "Repairs.None",
    "Borrower added on 01/01/13 >": "", "I started work on 01/01/13.": "I started work on 01/01/13.",
    "Ｃａｒ repairs": "Car repairs", "a​b\u0007c  d": "ab c d", "x<script>var a = '<b>';</script>y<style>p{}</style>z": "x y z",
    "<p>one</p><p>two</p>": "one two", "3 < 4 and 5 > 2": "3 < 4 and 5 > 2", "&lt;b&gt;bold&lt;/b&gt;": "bold", "<!-- hidden -->shown": "shown",
    'a<img alt="x > y">b': "a b", "é<a title='>'>c</a>&amp;": "é c &", 'open <b class="q>text': "open text", "ｎ／ａ": "",
}


def test_clean_text(spark):
    assert values(spark, CLEAN, X.clean_text) == list(CLEAN.values())


def test_payload_skips_empty_fields_and_labels_strip(spark):
    df = spark.createDataFrame([("Car", "debt__consolidation", "Title: inside: kept"), ("", "medical", "")], "title string, purpose string, desc string")
    made = X.payload({c: F.col(c) for c in ("title", "purpose", "desc")})
    got = [tuple(r) for r in df.select(made.alias("p"), X.strip_labels(made).alias("s")).collect()]
    assert got[0] == ("Title: Car\nPurpose: debt consolidation\nDescription: Title: inside: kept", "Car\ndebt consolidation\nTitle: inside: kept")
    assert got[1] == ("Purpose: medical", "medical")


def test_words(spark):
    text = "Don’t re-do 3rd x2 café_au-lait ÉTÉ — Straße!"
    expected = [t.casefold().replace("’", "'") for t in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", text)]
    assert values(spark, [text, "", "123 --"], X.words) == [expected, [], []]


WORDS = ["a", "the", "cat", "table", "apple", "tree", "three", "make", "maybe", "eye", "people", "rhythm", "prste", "nthe", "queue", "idea", "elle",
         "éléphant", "naïve", "style", "smile", "little", "bye", "eau", "eauee", "bcdf", "ale", "mille", "don't", "привет", "whole-some", "ooze", "yyye"]


def plain_syllables(word):
    w = re.sub("[^a-z]", "", unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode())
    if len(w) <= 3:
        return 1
    n = len(re.findall("[aeiouy]+", w)) - (w[-1] == "e" and w[-2] not in "ly") + (w.endswith("le") and w[-3] not in "aeiouy")
    return max(1, n)


def test_syllables_per_word_and_in_total(spark):
    expected = [plain_syllables(w) for w in WORDS]
    assert values(spark, WORDS, lambda c: X.syllables(X.ascii_letters(c))) == expected
    assert values(spark, WORDS, lambda c: X.total_syllables(F.array(c))) == expected
    assert values(spark, ["|".join(WORDS)], lambda c: X.total_syllables(F.split(c, "\\|"))) == [sum(expected)]


def test_lexical_features(spark):
    df = spark.createDataFrame([(1, "The medical bill was due. Pay the medical bill!"), (2, "12 34")], "doc_id int, t string")
    rows = {r["doc_id"]: r for r in X.lexical_features(df, "t").collect()}
    n, s, y = 9, 2, 1 + 3 + 1 + 1 + 1 + 1 + 1 + 3 + 1
    assert rows[1]["flesch_reading_ease"] == pytest.approx(206.835 - 1.015 * n / s - 84.6 * y / n)
    assert rows[1]["flesch_kincaid_grade"] == pytest.approx(0.39 * n / s + 11.8 * y / n - 15.59)
    assert rows[1]["lexical_diversity_ttr"] == pytest.approx(6 / 9)
    assert rows[1]["financial_distress_keyword_density"] == pytest.approx(2 / 9)
    assert tuple(rows[2])[2:] == (0.0, 0.0, 0.0, 0.0)


def test_ngrams_cross_removed_stop_words(spark):
    df = spark.createDataFrame([(1, "The red Car and a blue x car")], "doc_id int, t string")
    got = {r["term"]: r["tf"] for r in terms.term_counts(df, "t", ["the", "and"], (1, 2)).collect()}
    assert got == {"red": 1, "car": 2, "blue": 1, "red car": 1, "car blue": 1, "blue car": 1}


def test_strict_number_rejects_what_a_cast_accepts(spark):
    inputs = ["12", " 1.5e3 ", "12d", "abc", "", "-.5", "1_000"]
    got = values(spark, inputs, lambda c: F.struct(C.strict_double(C.blank_to_null(c)).alias("v"), C.not_numeric(C.blank_to_null(c)).alias("bad")))
    assert [(r["v"], r["bad"]) for r in got] == [(12.0, False), (1500.0, False), (None, True), (None, True), (None, False), (-0.5, False), (None, True)]


def integrated_tail(r, n):
    """Two-sided Student t tail by plain numerical integration of its density."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    grid = np.linspace(0, t, 200_001)
    return 1 - 2 * np.trapezoid(scale * (1 + grid ** 2 / df) ** (-(df + 1) / 2), grid)


@pytest.mark.parametrize("r, n", [(0.0, 10), (0.5, 27), (-0.5, 27), (0.2, 100), (0.9, 5), (-0.0207, 86_293), (0.03, 399)])
def test_correlation_p_value(r, n):
    assert lexical.correlation_p_value(r, n) == pytest.approx(integrated_tail(r, n), abs=1e-9)


def test_perfect_correlation_has_no_tail():
    assert lexical.correlation_p_value(1.0, 9) == 0.0 and lexical.correlation_p_value(0.3, 2) == 1.0


def test_constant_feature_is_refused(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0)], "target int, f double")
    with pytest.raises(ValueError, match="constant"):
        lexical.point_biserial(df, ["f"])


def test_a_batch_of_pages_is_cleaned_in_small_parts(spark):
    import pyarrow as pa

    from gradeline.functions import text as X

    pages = [None, "", *(f"<p>caf\u00e9 {k} &amp; more</p>" for k in range(150))]
    got = X.cleaned_markup.func(pa.array(pages, pa.string()))
    assert isinstance(got, pa.Array) and got.to_pylist() == [None, "", *(f" caf\u00e9 {k} & more " for k in range(150))]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(pages)], "k int, v string")
    assert {r["k"]: r["c"] for r in rows.select("k", X.clean_text(F.col("v")).alias("c")).collect()}[151] == "caf\u00e9 149 & more"


def test_terms_of_several_fields_wanted_and_distinct(spark):
    from gradeline.operators import terms

    rows = spark.createDataFrame([(1, "The \u0130X, b_1 b_1 of b_1!", "b_1 x9"), (1, None, ""), (2, "a \u00e9\u00e9\u00e9-\u4e2d\u6587", None)], "k int, t string, u string")
    counts = sorted((r["k"], r["term"], r["tf"]) for r in terms.term_counts(rows, "t", ["of", "the"], (1, 2), "k").collect())
    assert [c for c in counts if c[0] == 2] == [(2, "\u00e9\u00e9\u00e9", 1), (2, "\u00e9\u00e9\u00e9 \u4e2d\u6587", 1), (2, "\u4e2d\u6587", 1)]
    assert (1, "b_1", 3) in counts and (1, "b_1 b_1", 2) in counts and not any("of" in c[1] for c in counts)
    lists = terms.term_lists(rows, ["t", "u"], ["of"], (1, 1), ["k"], wanted=frozenset(["b_1"]), distinct=True)
    assert sorted((r["k"], r["terms"], r["tfs"]) for r in lists.collect()) == [(1, [], []), (1, ["b_1", "b_1"], [1, 1]), (2, [], [])]
    fields = terms.within_fields(rows, ["t", "u"], spark.createDataFrame([("b_1",), ("none",)], "term string"), [], (1, 2))
    assert {r["term"]: r["within_field_documents"] for r in fields.collect()} == {"b_1": 2, "none": 0}
