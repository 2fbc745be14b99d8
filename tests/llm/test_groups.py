"""Operators that compare rows: near and exact duplicates, repeated lines, and the pipeline."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeline.llm import components, exact, lines, minhash
from tests.llm import plain

SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(SENTENCE * 8)
    near = [f"{base} end {k}" for k in range(12)]
    rows = [(k, t) for k, t in enumerate([*near, None, "", " \n", "a", "A", "a b", base, base.upper(), "x" * 20000, "é é é é é"])]
    rows += [(50, near[0]), (50, near[0]), (None, "alone here"), (None, near[1])]
    return spark.createDataFrame([(*r, "y", 7) for r in rows], "doc_id bigint, text string, root string, band int")


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(chain, "x bigint, y bigint")).collect()))
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert components.connected(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


@pytest.mark.parametrize("words", [4, 5])
def test_near_groups(documents, words):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(documents, minhash.Settings(words=words)).collect()}
    assert got == plain.near_components(rows, words)


def test_near_groups_of_odd_rows(spark, odd):
    rows = minhash.near_groups(odd, minhash.Settings(block=3)).collect()
    known = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    expected = plain.near_components(known, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == expected
    nulls = sorted((r.n_shingles, r.component_id is None) for r in rows if r.doc_id is None)
    assert len(rows) == odd.count() and nulls[0] == (1, True) and not nulls[1][1]
    assert minhash.near_groups(odd.limit(0)).count() == 0
    assert minhash.without_near_duplicates(odd).columns == odd.columns


def test_blocks_of_a_hot_bucket_are_all_compared(spark):
    body = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(body[:k * 6] + [f"n{k}"] + body[k * 6 + 1:])) for k in range(60)]
    rows += [(100 + k, " ".join(body[:300] + [f"z{k}x{j}" for j in range(40)])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs, minhash.Settings(block=7)).collect()}
    assert got == plain.near_components(rows, 5)


def test_exact_groups(spark, documents, odd):
    for table in (documents, odd):
        rows = table.collect()
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = {}
        for r in rows:
            key = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
            best[norm(r.text)] = min(best.get(norm(r.text), (key, r.doc_id)), (key, r.doc_id), key=lambda x: x[0])
        got = exact.exact_groups(table, block=7).collect()
        assert sorted((str(r.doc_id), str(r.keep_id)) for r in got) == sorted((str(r.doc_id), str(best[norm(r.text)][1])) for r in rows)
        assert sum(r.kept for r in got) == len(best) and all(r.group_size >= 1 for r in got)
    assert exact.exact_groups(odd.limit(0)).count() == 0


def test_block_names_tell_all_bodies_apart(spark):
    bodies = ["", "a", "aa", "ab", "a" * 9, "a" * 10, "b" + "a" * 9, "a" * 9 + "b", "aab" * 11, "aab" * 11 + "a", "aa", "aab" * 11]
    rows = spark.createDataFrame([(k, b.encode()) for k, b in enumerate(bodies)], "uid bigint, body binary")
    names = {r.uid: (r.level, r.name) for r in exact.block_names(rows, 2).collect()}
    assert len(names) == len(bodies)
    assert all((names[a] == names[b]) == (bodies[a] == bodies[b]) for a in names for b in names)


@pytest.mark.parametrize("least", [3, 25])
def test_repeated_lines(documents, least):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = plain.repeated_lines(rows, least)
    got = {r.doc_id: r for r in lines.dedup_lines(documents, least).collect()}
    texts = dict(rows)
    for doc, gone in expected.items():
        assert got[doc].lines_removed == len(gone)
        assert got[doc].text == "\n".join(x for i, x in enumerate(texts[doc].split("\n")) if i not in gone)


def test_repeated_lines_of_odd_rows(spark):
    run = "a b c\n d e \nf g h i"
    rows = [(1, f"x y\n{run}\nz"), (2, f"{run}\n\nq"), (3, None), (4, ""), (5, "\n".join(["k l"] * 9)), (2, f"{run}\n\nq"), (None, f"{run}\nlast"),
            (6, "a b c\nd e\n\n\nf g h i")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lines int")
    got = {(r.doc_id, r.lines_removed): r.text for r in lines.dedup_lines(table, 9).collect()}
    assert got[1, 0] == rows[0][1] and got[2, 3] == "\nq" and got[3, 0] is None and got[4, 0] == "" and got[None, 3] == "last"
    assert got[5, 0] == rows[4][1] or len(got[5, 4].split("\n")) == 5
    assert got[6, 5] == ""
    assert lines.dedup_lines(table.limit(0)).count() == 0


def test_pipeline_stages(spark, sf, documents):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, sf)
        assert done.columns == documents.columns
        kept[name] = {r.doc_id: r.text for r in done.collect()}
        docs = spark.createDataFrame(done.collect(), documents.schema)
        assert set(kept[name]) <= {r.doc_id for r in documents.select("doc_id").collect()}
    rows = sorted(kept["toxicity"].items())
    gone = plain.repeated_lines(rows, lines.MIN_WORDS)
    rest = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}
    rest = {d: t for d, t in rest.items() if not gone[d] or plain.WORD.search(t)}
    assert kept["line_dedup"] == rest
    groups = plain.near_components(sorted(rest.items()), 5)
    assert set(kept["near_dedup"]) == {d for d, (_, root) in groups.items() if d == root}
    assert set(kept["secret_scan"]) == set(kept["near_dedup"])
    assert not any(plain.base_spans(t) for t in kept["secret_scan"].values() if "secret" not in t)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == len(kept["secret_scan"])


def test_pipeline_takes_odd_columns(spark, sf):
    rows = [(1, None, "en", None, None), (None, "a b", None, "s", 3), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("score", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 3
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), sf).count() == 0


def test_texts_of_very_many_lines(spark):
    body = [f"line {k % 150_000} of a long text" for k in range(200_000)]
    docs = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(body[:50])), (3, "alone")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["lines"], r["lines_removed"]) for r in lines.dedup_lines(docs).collect()}
    assert got == {1: (200_000, 50_000), 2: (50, 50), 3: (1, 0)}
