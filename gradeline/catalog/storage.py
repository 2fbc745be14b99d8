"""Reader, sink, manifest and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradeline import views
from gradeline.catalog.base import ORACLES, query, r9, rounded, s9
from gradeline.catalog.contracts import mapping, score_join
from gradeline.catalog.modelling import ARTIFACT, predict_input, stacking_rows
from gradeline.operators import fusion
from gradeline.plans import runs
from gradeline.sources import manifests, readers, sinks
from gradeline.streaming import score_stream


def new_path(spark, name):
    """A fresh location in the shared folder."""
    return f"{runs.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_source(spark, sf):
    """The raw records as CSV files in record order, quoted fields with line breaks included."""
    path = new_path(spark, "raw-csv")
    raw = views.raw_loans(spark, sf).withColumn("desc", F.concat(F.col("desc"), F.lit('\n"line two", '), F.col("title")))
    raw.repartitionByRange(6, "source_row_number").sortWithinPartitions("source_row_number").drop("source_row_number").write.csv(
        path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("csv_scan", """select row_number() over (order by source_row_number) as source_row_number, issue_d, loan_status, md5("desc" || chr(10) || '"line two", ' || title) as desc_digest from raw_loans""", "raw_loans")
def csv_scan(spark, sf):
    """All-text CSV records, numbered from 1 in file order before any filter."""
    raw = readers.read_raw_csv(spark, csv_source(spark, sf), ["issue_d", "loan_status", "desc"])
    return readers.with_source_row_number(raw).select("source_row_number", "issue_d", "loan_status", F.md5("desc").alias("desc_digest"))


@query("record_count", """select 'record_count_difference' as "check", abs(count(*) - (select count(*) from raw_loans)) as violations, count(*) = (select count(*) from raw_loans) as passed from orders""", "raw_loans")
def record_count(spark, sf):
    """S3: records read from the CSV files against the recorded count."""
    recorded = views.table(spark, sf, "orders").count()
    return readers.record_count_check(readers.read_raw_csv(spark, csv_source(spark, sf)), recorded)


@query("description_scan", """select source_row_number, md5("desc") as digest from raw_loans""", "raw_loans")
def description_scan(spark, sf):
    """One text column and its key, no outcome column."""
    out = readers.descriptions_only(views.raw_loans(spark, sf), ["source_row_number"])
    return out.select("source_row_number", F.md5("desc").alias("digest"))


@query("score_files", """select loan_id, role, p_a from loans where role is not null""", "loans")
def score_files(spark, sf):
    """Score files read back by suffix, CSV and Parquet, the id as text."""
    rows = views.loans(spark, sf).filter("role is not null").select("loan_id", "role", "p_a")
    as_csv, as_parquet = new_path(spark, "scores") + ".csv", new_path(spark, "scores") + ".parquet"
    rows.filter("role = 'validation'").write.csv(as_csv, header=True)
    rows.filter("role <> 'validation'").write.parquet(as_parquet)
    return readers.read_scores(spark, as_csv).unionByName(readers.read_scores(spark, as_parquet))


@query("candidate_loader", """select 'a' as candidate, case when split = 'validation' then 'validation' else 'calibration' end as "set", loan_id, p_a as p, target, 'logistic_regression' as model_name, 'tabular-v1' as model_version
  from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')""", "loans")
def candidate_loader(spark, sf):
    """C14: one candidate's two score files, a CSV and a Parquet one, checked against the expected ids, with outcomes by id."""
    rows = views.loans(spark, sf)
    expected = fusion.expected_ids(rows, {"calibration": ["fusion_fit", "fusion_calibration"], "validation": ["validation"]}).persist()
    table = fusion.prediction_table(rows.filter(F.col("role").isin("fusion_fit", "fusion_calibration", "validation")), F.col("p_a"), "logistic_regression", "tabular-v1")
    as_csv, as_parquet = new_path(spark, "candidate") + ".csv", new_path(spark, "candidate") + ".parquet"
    table.filter("split = 'train'").write.csv(as_csv, header=True)
    table.filter("split = 'validation'").write.parquet(as_parquet)
    return fusion.load_candidate("a", {"calibration": readers.read_scores(spark, as_csv), "validation": readers.read_scores(spark, as_parquet)}, expected)


@query("parquet_roundtrip", f"select loan_id, role, p_a, {s9('p_b / 3')} as third, 'v1' as feature_version from loans where role is not null", "loans")
def parquet_roundtrip(spark, sf):
    """Staged write to a location that must be new, read-back verification by key, then swap."""
    rows = views.loans(spark, sf).filter("role is not null").select("loan_id", "role", "p_a", (F.col("p_b") / 3).alias("third"))
    return rounded(sinks.replace_verified(rows, new_path(spark, "features"), "loan_id", ["p_a", "third"], "v1"))


_HANDOFF = "select loan_id, split, role, p_a as p_default_tabular, {text} as p_default_text, '{version}' as table_version from loans where role in ('fusion_fit', 'fusion_calibration', 'validation')"


@query("handoff_tables", _HANDOFF.format(text="null::double", version="one_score") + " union all " + _HANDOFF.format(text="p_b", version="two_score"), "loans")
def handoff_tables(spark, sf):
    """Two table versions by role, written only after every check passes, read back as one table."""
    two = score_join(spark, sf).persist()
    one = two.drop("p_default_text", "text_model_version")
    pins = {"tabular": "tabular-v1", "text": "text-v2"}
    labels = mapping(spark, sf)
    checked = {"two_score": fusion.fusion_checks(two, labels, pins), "one_score": fusion.fusion_checks(one, labels, {"tabular": "tabular-v1"})}
    out = sinks.write_handoff({"one_score": one, "two_score": two}, checked, new_path(spark, "handoff"))
    return out.select("loan_id", "split", "role", "p_default_tabular", "p_default_text", "table_version")


@query("role_manifest", """select role, count(*) as rows, min(issue_month) as first_month, max(issue_month) as last_month, 'orders_v1' as dataset_version, 'roles_v1' as role_version
  from loans where role is not null group by role""", "loans")
def role_manifest(spark, sf):
    """Role rows and month ranges read back from the written mapping."""
    path = new_path(spark, "mapping")
    views.loans(spark, sf).filter("role is not null").select("loan_id", "split", "role", "issue_month").write.mode("errorifexists").parquet(path)
    return manifests.role_manifest(spark.read.parquet(path), {"dataset_version": "orders_v1", "role_version": "roles_v1"})


FP = """count(*) as rows, cast(sum(h) as varchar) as digest_sum, bit_xor(h) as digest_xor"""


def row_hash(*columns: str) -> str:
    """SQL of the row digest ``h``: values after their lengths, a mark for NULL."""
    parts = ", ".join(f"coalesce(length({c}) || ':' || {c}, '~')" for c in columns)
    return f"('0x' || substr(md5(concat({parts})), 1, 15))::bigint as h"


@query("table_fingerprint", f"select role, {FP} from (select role, {row_hash('loan_id', 'issue_month')} from loans where role is not null) group by role", "loans")
def table_fingerprint(spark, sf):
    """Order-free digest of an id set per role, with its count."""
    return manifests.fingerprint(views.loans(spark, sf).filter("role is not null"), ["loan_id", "issue_month"], ["role"])


@query("fingerprint_audit", f"""with c as (select source, bit_xor(h) as x from (select source, {row_hash('doc_id::varchar', 'text')} from documents) group by source),
  r as (select source, case when source = 'src3' then null when source = 'src5' then x + 1 else x end as x from c where source <> 'src7' union all select 'src99', 1)
  select source, case when r.source is null then 'not recorded' when c.source is null then 'not found' when r.x is null then 'no pin' when r.x = c.x then 'equal' else 'changed' end as state,
    coalesce(r.x = c.x, false) as passed from r full join c using (source)""")
def fingerprint_audit(spark, sf):
    """Recorded against current digests: same keys, same content, a missing pin refused."""
    current = manifests.fingerprint(views.table(spark, sf, "documents"), ["doc_id", "text"], ["source"]).select("source", F.col("digest_xor").alias("digest")).persist()
    tampered = F.when(F.col("source") == "src3", None).when(F.col("source") == "src5", F.col("digest") + 1).otherwise(F.col("digest"))
    recorded = current.filter("source <> 'src7'").select("source", tampered.alias("digest"))
    recorded = recorded.unionByName(recorded.agg(F.lit("src99").alias("source"), F.lit(1).cast("long").alias("digest")))
    return manifests.compare_checksums(recorded, current, "source", "digest")


@query("file_checksums")
def file_checksums(spark, sf):
    """SHA-256 of the table files (a unit test compares it with hashlib)."""
    return manifests.file_checksums(spark, [f"{sf}/{t}.parquet" for t in ("orders", "customer", "labels")]).select("length", "sha256")


@query("output_record", f"""select 'scores' as "table", model_version, 'loan_id,p,model_version' as columns, {FP}
  from (select case when p_a > 0.5 then 'v1' else 'v2' end as model_version, {row_hash('loan_id')} from loans where role is not null) group by model_version""", "loans")
def output_record(spark, sf):
    """One manifest row per version of a written table."""
    rows = views.loans(spark, sf).filter("role is not null").select("loan_id", F.col("p_a").alias("p"), F.when(F.col("p_a") > 0.5, "v1").otherwise("v2").alias("model_version"))
    return manifests.output_record(rows, "scores", ["loan_id"], "model_version")


@query("artifact_roundtrip")
def artifact_roundtrip(spark, sf):
    """A fitted stacker written as JSON and read back under its schema."""
    path = new_path(spark, "artifact")
    sinks.write_artifact(runs.artifact_table(spark, runs.stacker_artifact(stacking_rows(spark, sf), "tabular_text", ["tabular", "text"])), path)
    back = readers.read_artifact(spark, path, runs.ARTIFACT_SCHEMA)
    return back.select("variant", F.array_join("tracks", ",").alias("tracks"), F.size("coefficients").alias("coefficients"), "calibrator.method")


@query("stream_scores", ORACLES["fallback_scores"])
def stream_scores(spark, sf):
    """The same scoring expression over a file stream; equal to the batch result."""
    path = new_path(spark, "arrivals")
    predict_input(spark, sf).repartition(3).write.parquet(path)
    arrivals = score_stream.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=2)
    out = score_stream.score_available(arrivals, ARTIFACT, new_path(spark, "scored"), new_path(spark, "stream-checkpoint"))
    return out.drop("p_default_tabular", "p_default_text").withColumn("p_default", r9("p_default"))
