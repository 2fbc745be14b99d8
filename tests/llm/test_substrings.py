"""Removal of repeated strings against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import queries, substrings

SMALL = substrings.Settings(least=40, gram=16, group=8, batch=64)


def plain_repeats(rows, least):
    """[(doc, n_bytes, removed, runs, sha256 of the rest)] by counting all strings."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + least] for _, b in data for i in range(len(b) - least + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - least + 1):
            if seen[b[i:i + least]] > 1:
                gone[i + 1:i + least + 1] = True
        rest = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def found_repeats(docs, settings):
    done = substrings.without_repeats(docs, settings).select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]), F.size("spans"),
        F.coalesce(F.sha2("kept", 256), F.col("text_sha256")))
    return sorted((tuple(r) for r in done.collect()), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    shared = [words(rng, 40) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [words(rng, rng.randint(0, 25)) for _ in range(3)]
        if k % 2:
            parts.insert(1, shared[k % 4][rng.randint(0, 30):rng.randint(60, 200)])
        rows.append((k, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a" * 39), (105, "b" * 300),
             (106, "xy" * 100), (107, rows[5][1] + rows[5][1]), (None, rows[7][1]), (None, shared[0])]
    return rows


def test_equals_plain_counting(spark, passages):
    docs = spark.createDataFrame([(*r, 1, "z") for r in passages], "doc_id bigint, text string, k1 int, gram string")
    assert found_repeats(docs, SMALL) == plain_repeats(passages, 40)


def test_hot_groups_are_split(spark):
    rng = random.Random(9)
    shared = words(rng, 30)
    rows = []
    for k in range(120):
        at = rng.randint(0, len(shared) - 1)
        rows.append((k, words(rng, 8) + shared[:at] + "#" + str(k) + shared[at:] + words(rng, 8)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for group in (2, 2048):
        got = found_repeats(docs, substrings.Settings(least=40, gram=16, group=group, batch=64))
        assert got == plain_repeats(rows, 40)


def test_segments_of_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    body = words(rng, 3000)
    rows = [(1, body), (2, words(rng, 50) + body[5000:5300] + words(rng, 50)), (3, body[:700])]
    anchors = substrings.Anchors(SMALL)
    monkeypatch.setattr(substrings, "_SEGMENT", 1 << 10)
    octets = np.frombuffer(body.encode(), np.uint8)
    _, lo, hi, gram, _ = anchors.found(octets, np.array([0, len(octets)]))
    assert lo[0] == 0 and hi[-1] == len(octets) - 40 and (lo[1:] == hi[:-1] + 1).all() and ((gram >= lo) & (gram <= hi + 24) & (gram >= hi - 24)).all()
    assert found_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL) == plain_repeats(rows, 40)


def test_empty_table(spark):
    assert found_repeats(spark.createDataFrame([], "doc_id bigint, text string"), SMALL) == []


def test_whole_texts_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.substring_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_repeats(rows, 400)


def test_columns_share_symbols_only_inside_a_group():
    settings = substrings.Settings(least=5, gram=3)
    group, col, span = np.array([0, 0, 0, 1]), np.array([2, 1, 2, 2]), np.array([0, 1, 0, 0])
    marks = substrings.repeated_starts(group, col, span, [b"abcde", b"xabcde", b"abcdf", b"abcde"], settings)
    assert marks.T.tolist() == [[False, False, True], [False, False, True], [False] * 3, [False] * 3]
