"""Isotonic blocks, tails, draws, ordered sentiment, in-row counts and refused scores against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.operators import calibration, isotonic, lexical, roles, scoring, terms


def plain_pooling(groups):
    out = []
    for p, pos, neg in sorted(groups):
        out.append([p, p, pos, pos + neg])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return out


@pytest.mark.parametrize("shape", ["rising", "falling", "noise", "sawtooth"])
@pytest.mark.parametrize("size", [7, 40, 10**6])
def test_isotonic_blocks_do_not_depend_on_ranges(spark, shape, size):
    rng = random.Random(shape)
    rate = {"rising": lambda i: i, "falling": lambda i: 300 - i, "noise": lambda i: rng.randint(0, 300), "sawtooth": lambda i: i % 60 + i // 6}[shape]
    groups = [(round(i / 300, 6), rate(i) + 1, 320 - rate(i)) for i in range(300)]
    table = spark.createDataFrame(groups, "p double, pos long, neg long")
    got = sorted([r["low"], r["high"], r["events"], r["rows"]] for r in isotonic.isotonic_blocks(table, size).collect())
    expected = plain_pooling(groups)
    assert got == expected
    x = [(v,) for v in (-1.0, 0.0, 0.0015, 0.5, 0.5015, 0.77, 0.996, 2.0)]
    fitted = {r["x"]: r["f"] for r in isotonic.interpolated(spark.createDataFrame(x, "x double"), spark.createDataFrame(expected, isotonic._BLOCK), "x", "f", size).collect()}
    ends = sorted({(b[k], b[2] / b[3]) for b in expected for k in (0, 1)})
    for (v,) in x:
        assert fitted[v] == pytest.approx(np.interp(v, *zip(*ends, strict=True)), abs=1e-12)


def test_isotonic_calibrator_keeps_rows_and_null_scores(spark):
    rows = spark.createDataFrame([(float(k % 20) / 20, k % 3 == 0 or k % 20 > 14) for k in range(400)], "p double, hit boolean").select("p", F.col("hit").cast("int").alias("target"))
    fitted = calibration.fit_isotonic(rows, rows_per_range=6)
    out = fitted.apply(rows.unionByName(spark.createDataFrame([(None, 0)], "p double, target int")), "p", "c").collect()
    assert len(out) == 401 and sum(r["c"] is None for r in out) == 1 and fitted.details["steps"] >= 2


def test_student_tail_at_known_points():
    for t in (0.001, 0.3, 1.0, 2.5, 9.0, 40.0):
        share = lambda v: t * t / (v + t * t)  # noqa: B023, E731
        assert lexical.student_tail(1, share(1)) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-10)
        assert lexical.student_tail(2, share(2)) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
    nodes, weights = np.polynomial.legendre.leggauss(200)
    for freedom in (8, 50, 1000, 99_998, 1_000_000, 1_000_002, 10**9, 10**11):
        for t in (0.5, 1.96, 4.0, 6.0):
            x = (nodes + 1) * 0.5 * t
            log_density = -(freedom + 1) / 2 * np.log1p(x * x / freedom) + lexical._log_gamma_ratio(freedom / 2) - 0.5 * math.log(freedom * math.pi)
            expected = 1 - 2 * (np.exp(log_density) * weights).sum() * 0.5 * t
            assert lexical.student_tail(freedom, t * t / (freedom + t * t)) == pytest.approx(expected, abs=1e-10)


def test_draws_are_exact_and_sort_no_rows(spark):
    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("loan_id"), (F.col("id") % 7 == 0).cast("int").alias("target"))
    rows = rows.unionByName(spark.createDataFrame([("n1", None), ("n2", None)], "loan_id string, target int"))
    folds = roles.stratified_folds(rows, "loan_id", 4, "s").collect()
    sizes = Counter((r["target"], r["fold"]) for r in folds)
    assert len(folds) == 5002 and all(max(v) - min(v) <= 1 for v in ([sizes[t, f] for f in range(4)] for t in (0, 1, None)))
    draw = lambda k: int(hashlib.md5(f"q|{k}".encode()).hexdigest()[:15], 16)
    for n in (0, 1, 501, 5002):
        sample = roles.stratified_sample(rows, "loan_id", n, "q")
        got = sample.collect()
        assert len(got) == n
        for target in (0, 1):
            all_ids = sorted((f"k{i}" for i in range(5000) if (i % 7 == 0) == bool(target)), key=draw)
            mine = [r["loan_id"] for r in got if r["target"] == target]
            assert set(mine) == set(all_ids[:len(mine)])
    plan = roles.stratified_sample(rows, "loan_id", 501, "q")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort [_d" not in plan


def plain_sentiment(tokens, lexicon):
    tokens = [t for t in tokens if len(t) > 1]
    scores, boost, negated = [], 1.0, False
    for t in tokens:
        kind, p, s, i = lexicon.get(t, (None, 0, 0, 1))
        if kind == "boost":
            boost *= i
        elif kind == "negation":
            boost, negated = 1.0, True
        else:
            if kind == "score":
                scores.append((max(-1, min(1, p * (-0.5 / boost if negated else boost))), max(0, min(1, s * (1 / boost if negated else boost)))))
            boost, negated = 1.0, False
    return tuple(sum(x[k] for x in scores) / len(scores) if scores else 0.0 for k in (0, 1))


def test_sentiment_follows_token_order(spark):
    lexicon = {"good": ("score", 0.7, 0.6, 1.0), "bad": ("score", -0.6, 0.7, 1.0), "very": ("boost", 0.0, 0.0, 1.3), "so": ("boost", 0.0, 0.0, 2.0),
               "not": ("negation", 0.0, 0.0, 1.0), "never": ("negation", 0.0, 0.0, 1.0)}
    rng = random.Random(1)
    texts = ["good", "not good", "not very good", "very so bad", "not a good day", "not the good day", "", "nothing known", "very"]
    texts += [" ".join(rng.choice([*lexicon, "a", "day", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(w, *v) for w, v in lexicon.items()], "word string, kind string, polarity double, subjectivity double, intensity double")
    got = {r["id"]: (r["sentiment_polarity"], r["sentiment_subjectivity"]) for r in lexical.ordered_sentiment(docs, "id", F.split("text", " "), table).collect()}
    for k, text in enumerate(texts):
        assert got[k] == pytest.approx(plain_sentiment(text.split(), lexicon), abs=1e-12), text


def test_terms_are_counted_inside_rows(spark):
    texts = ["the cat the dog the cat", "", "a", None, "bb aa bb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    table = terms.term_counts(docs, "text", ["the"], (1, 2))
    got = {(r["doc_id"], r["term"]): r["tf"] for r in table.collect()}
    assert got == {(0, "cat"): 2, (0, "dog"): 1, (0, "cat dog"): 1, (0, "dog cat"): 1, (4, "bb"): 2, (4, "aa"): 1, (4, "bb aa"): 1, (4, "aa bb"): 1}
    plan = terms.vocabulary(table, docs, 5)._jdf.queryExecution().executedPlan().toString()
    assert all("text#" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


@pytest.mark.parametrize("bad", [None, float("nan")])
@pytest.mark.parametrize("bounds", [[], [0.2, 0.4, 0.6]])
def test_missing_scores_are_refused_at_every_size(spark, bad, bounds):
    rows = spark.createDataFrame([(k / 50, k % 2) for k in range(50)] + [(bad, 1)], "p double, target int")
    for attempt in (lambda: scoring.evaluate(rows, bounds=bounds), lambda: scoring.curve_points(rows), lambda: rows.agg(*scoring.confusion(F.col("p"), F.col("target"), 0.5)),
                    lambda: scoring.threshold_sweep(rows, bounds or [0.5]), lambda: scoring.threshold_for_recall(rows, [0.5]), lambda: scoring.reliability(rows, 4, "uniform")):
        with pytest.raises(Exception, match="scores must be present"):
            attempt().collect()
