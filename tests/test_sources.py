"""Row numbers, verified sinks, checksums and the stream."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gradeline.operators import checks, fusion
from gradeline.sources import manifests, readers, sinks


@pytest.mark.parametrize("files", [1, 3, 8])
def test_row_numbers_follow_the_files(spark, tmp_path, files):
    path = str(tmp_path / "raw")
    rows = spark.range(1, 501).select(F.col("id").alias("n"), F.when(F.col("id") % 7 == 0, "NA").when(F.col("id") % 5 == 0, 'two\n"lines", x').alias("desc"))
    rows.repartitionByRange(files, "n").sortWithinPartitions("n").write.csv(path, header=True, escape='"')
    raw = readers.read_raw_csv(spark, path, ["n", "desc"])
    got = readers.with_source_row_number(raw).collect()
    assert len(got) == 500 and all(r["source_row_number"] == int(r["n"]) for r in got)
    assert {r["desc"] for r in got if int(r["n"]) % 7 == 0} == {"NA"}
    with pytest.raises(checks.ContractError, match="missing columns"):
        readers.read_raw_csv(spark, path, ["nope"])


def test_row_numbers_of_a_split_file(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(1, 20001).select(F.col("id").alias("n"), F.lit("x" * 20).alias("t")).coalesce(1).write.csv(path, header=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        raw = readers.read_raw_csv(spark, path, multi_line=False)
        assert raw.rdd.getNumPartitions() > 4
        assert readers.with_source_row_number(raw).filter("source_row_number <> n").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sinks_verify_and_refuse(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.25), ("b", None)], "loan_id string, p double")
    out = str(tmp_path / "t")
    assert sinks.write_verified(rows, out, "loan_id", ["p"]).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_verified(rows, out, "loan_id", ["p"])
    changed = rows.withColumn("p", F.lit(0.5))
    assert {r["check"]: r["violations"] for r in sinks.written_checks(changed, rows, "loan_id", ["p"]).collect()}["differs_p"] == 2
    for version in ("v1", "v2"):
        assert sinks.replace_verified(rows, str(tmp_path / "swap"), "loan_id", ["p"], version).select("feature_version").first()[0] == version
    with pytest.raises(ValueError, match="Parquet"):
        sinks.write_summary_csv(spark.range(5), str(tmp_path / "csv"), max_rows=3)
    with pytest.raises(checks.ContractError):
        sinks.write_handoff({"v": rows}, {"v": checks.row_checks(rows, {"null_p": F.col("p").isNull()})}, str(tmp_path / "handoff"))
    assert not (tmp_path / "handoff").exists()


def test_checksums_and_digests(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"abc\n")
    row = manifests.file_checksums(spark, [str(tmp_path / "f.txt")]).first()
    assert row["sha256"] == hashlib.sha256(b"abc\n").hexdigest() and row["length"] == 4
    ids = spark.createDataFrame([("b",), ("a",), ("c",)], "loan_id string")
    assert manifests.exact_id_digest(ids) == hashlib.sha256(b"a\nb\nc").hexdigest()
    with pytest.raises(ValueError, match="fingerprint"):
        manifests.exact_id_digest(ids, max_rows=2)
    assert manifests.fingerprint(ids, ["loan_id"]).collect() == manifests.fingerprint(ids.repartition(3).orderBy("loan_id"), ["loan_id"]).collect()


def test_frozen_names_absent(spark, sf):
    """The locked split has no role in any view."""
    from gradeline import views

    assert views.loans(spark, sf).filter("split = 'test' and role is not null").count() == 0


def test_fingerprint_tells_nulls_and_separators_apart(spark):
    from gradeline.sources import manifests

    one = spark.createDataFrame([(None, "x"), ("a|b", "c")], "a string, b string")
    two = spark.createDataFrame([("x", None), ("a", "b|c")], "a string, b string")
    left, right = (manifests.fingerprint(t, ["a", "b"]).first() for t in (one, two))
    assert left.digest_sum != right.digest_sum and left.digest_xor != right.digest_xor


def test_odd_numbers_differ_and_dotted_keys_are_found(spark):
    from pyspark.sql import functions as F

    from gradeline.functions import columns

    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(0.5, nan), (nan, 0.5), (1.0, inf), (inf, 1.0), (inf, inf), (0.5, 0.5), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(columns.differs(F.col("a"), F.col("b"), 1e-6, 1e-6)).collect()] == [True] * 4 + [False, False, True]
    value = spark.range(1).select(columns.json_value(F.lit('{"a.b": {"c": 3}}'), "a.b", "c")).first()[0]
    assert value == "3"


def test_ids_of_csv_scores_stay_text(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    spark.createDataFrame([("00012", 0.5), ("7", 0.25)], "loan_id string, p double").write.csv(path, header=True)
    assert sorted(map(tuple, readers.read_scores(spark, path).collect())) == [("00012", 0.5), ("7", 0.25)]


def test_candidate_files_must_agree(spark):
    expected = spark.createDataFrame([("calibration", "a", 0), ("calibration", "b", 1), ("validation", "c", 1)], "set string, loan_id string, target int")
    schema = "loan_id string, split string, p_default_tabular double, model_name string, model_version string"
    table = lambda rows: spark.createDataFrame(rows, schema)
    first, second = [("a", "train", 0.1, "m", "v1"), ("b", "train", 0.2, "m", "v1")], [("c", "validation", 0.3, "m", "v1")]
    rows = fusion.load_candidate("x", {"calibration": table(first), "validation": table(second)}, expected)
    assert {(r["set"], r["loan_id"], r["p"], r["target"]) for r in rows.collect()} == {("calibration", "a", 0.1, 0), ("calibration", "b", 0.2, 1), ("validation", "c", 0.3, 1)}
    for bad in ([("c", "validation", 0.3, "m", "v2")], [("c", "validation", 1.3, "m", "v1")], [("d", "validation", 0.3, "m", "v1")], [("c", "validation", 0.3, " ", "v1")]):
        with pytest.raises(checks.ContractError):
            fusion.load_candidate("x", {"calibration": table(first), "validation": table(bad)}, expected)
