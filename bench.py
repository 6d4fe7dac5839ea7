"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, and
``BENCH_QUERIES`` a comma-separated subset. Each query runs to a sink that
discards the rows, after one small query that warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from reviewfold.plans.registry import all_queries  # noqa: E402

HEADLINE = (
    "label_override inner_join_locations null_safe_join categorize_first_match rule_match_counts "
    "filtered_counts crosstab_owner_cost entity_rate group_summary mean_ci six_number_summary quantiles histogram "
    "window_count window_rate first_per_key top_segments rank_categories welch_p welch_pairwise segment_tests ks_p "
    "attach_tier segment_report clean_text tokenize holdout_split holdout_assignments vocabulary encode_tokens pad_pre "
    "vector_lookup embedding_table ngrams prune_terms tfidf_weights embedding_pool binary_metrics logistic_predict "
    "score_reviews rbf_svm_predict embedding_mlp repeated_holdout model_roundtrip token_attribution"
).split()


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reviewfold-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    known = all_queries()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    known["entity_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
