"""Hard-negative mining against a plain search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import negatives

SMALL = negatives.Settings(blocks=5, rows=64, anchors=7)


def plain(rows, low=80, positives=5, count=5):
    """rows: (vec_id, label, ints, anchor)."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (vec, label, v, anchor) in enumerate(rows):
        if not anchor:
            continue
        near = sorted((-score(v, r[2]), r[0]) for j, r in enumerate(rows) if j != i and r[1] == label)[:positives]
        far = sorted((-score(v, r[2]), r[0]) for r in rows if r[1] != label)
        for minus, positive in near:
            p = -minus
            inside = [(-n, other) for n, other in far if low * p <= 100 * -n <= 100 * p][:count]
            out += [(vec, positive, k + 1, other, p, n) for k, (n, other) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, settings=SMALL):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, label bigint, v array<bigint>, anchor boolean, uid int, block int")
    return sorted(tuple(r) for r in negatives.hard_negatives(table, settings).collect())


def vectors(rng, n, dims, spread):
    centres = [[rng.randint(-spread, spread) for _ in range(dims)] for _ in range(3)]
    return [(k, k % 4, [c + rng.randint(-spread // 2, spread // 2) for c in centres[k % 3]], k % 9 == 0) for k in range(n)]


@pytest.mark.parametrize("spread,dims", [(100, 8), (3, 2), (5, 40)])
def test_equals_plain_search(spark, spread, dims):
    rows = vectors(random.Random(spread), 300, dims, spread)
    assert mined(spark, rows) == plain(rows)


def test_copies_ties_few_rows_and_lone_labels(spark):
    rng = random.Random(4)
    rows = vectors(rng, 60, 6, 20) + [(1000 + k, k % 4, [9, 9, 9, 9, 9, 9], k == 5) for k in range(150)]
    rows += [(2000, 77, [1, 2, 3, 4, 5, 6], True), (2001, 78, [], True), (2002, 78, [4], True), (2003, 79, [0] * 6, True), (2004, 79, [0] * 6, False)]
    rows += [(7, 3, [5, 5, 5, 5, 5, 5], True), (7, 3, [5, 5, 5, 5, 5, 5], True), (2005, 80, [-9] * 6, True), (2006, 80, [9] * 6, None)]
    assert mined(spark, rows) == plain(rows)


def test_huge_components_and_empty_table(spark):
    rows = [(k, k % 2, [(k - 10) * 10**8, k * 10**8 + 1], k % 5 == 0) for k in range(20)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == []
    wide = negatives.integer_products(np.array([[2**62, 2**62], [-(2**62), -5]]), np.array([[4, 4], [4, 4]]))
    assert wide.tolist() == [2**63 - 1, -(2**63)]
    assert mined(spark, [(1, 1, [1, 2], False)]) == []


def test_usable_rows(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, None, [0.5]), (3, 1, None), (4, 1, [0.5, None]), (5, 1, [math.nan]), (6, 1, [math.inf]), (None, 1, [0.1]), (7, 2, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumn("v", F.lit("clash"))
    assert [tuple(r) for r in negatives.usable(table).orderBy("vec_id").collect()] == [(1, 1, [128, -1]), (7, 2, [])]


def test_index_leaves_dimensions_out_and_loses_nothing():
    rng = np.random.default_rng(1)
    matrix = rng.integers(-150, 150, (500, 64))
    matrix[:, 10:] //= 10
    block = negatives.Block(np.arange(500), np.arange(500), np.zeros(500, np.int64), matrix)
    scores = matrix[:20] @ matrix.T
    least = np.sort(scores, 1)[:, -6]
    norms = np.linalg.norm(matrix[:20].astype(float), axis=1)
    assert ((block.norms < (least / norms).min()).sum(1) - 1).mean() > 4  # groups of dimensions that no posting holds
    for q, (rows, found) in enumerate(negatives.joined_above(block, matrix[:20], least)):
        expected = np.flatnonzero(scores[q] >= least[q])
        assert sorted(rows) == expected.tolist() and (found == scores[q][rows]).all()
