"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input and the cores.
Every query runs to the end (a noop write of its whole result); the best of BENCH_RUNS runs counts.
"""

from __future__ import annotations

import json
import os
import time

from gradeline import catalog, views
from gradeline.catalog.bootstrap import MARGINS
from gradeline.catalog.modelling import calibration_rows
from gradeline.operators import resample
from gradeline.plans import runs
from gradeline.session import local_session


def bootstrap_1000(spark, sf):
    """Four metrics, one pair of scores, 1,000 paired resamples."""
    rows = views.loans(spark, sf).filter("role = 'validation'").select("loan_id", "target", "p_a", "p_b")
    return resample.paired_deltas(rows, [("p_b", "p_a")], 1000)


def calibration_decision_1000(spark, sf):
    """Two candidates, three calibrators each, method choice and champion rule with 1,000 resamples."""
    return runs.calibration_decision(calibration_rows(spark, sf), "p_a", "p_b", MARGINS, replicates=1000)


NAMES = (
    "metric_row", "metric_rows_by_version", "subgroup_metrics", "policy_curve", "approval_rates", "threshold_sweep", "reliability_quantile",
    "cohort_registry", "registry_audit", "fold_checks", "stratified_folds", "score_join", "export_checks", "feature_table", "split_profile",
    "lexical_table", "keyword_sources", "vocabulary", "tfidf_weights", "term_flags", "clean_pages", "outcome_summary",
    "logistic_run", "out_of_fold_scores", "boosted_trees", "text_baseline", "text_score_export", "calibration_run", "stacker",
    "fallback_scores", "stream_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    work = {name: catalog.QUERIES[name] for name in NAMES}
    work |= {"bootstrap_1000": bootstrap_1000, "calibration_decision_1000": calibration_decision_1000}
    repeats = int(os.environ.get("BENCH_RUNS", "1"))
    catalog.QUERIES["mean_risk"](spark, sf_dir).collect()  # start-up
    seconds = {}
    for name, build in work.items():
        best = None
        for _ in range(repeats):
            started = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - started
            best = taken if best is None else min(best, taken)
            spark.catalog.clearCache()
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
