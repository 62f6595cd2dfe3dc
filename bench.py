"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from papyrine.plans.registry import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
HEADLINE = (
    "rk2_keyword_score", "rk6_search_modes", "rk8_knn_filtered", "rk10_dual_interleave", "rk14_merge_retrievers", "jn1_either_key", "jn8_range_phase",
    "jn9_similarity_within", "jn16_best_match", "ag11_usage_grouping_sets", "ag15_dedup_merge", "ag19_numeric_profile", "ag25_report_rollup", "ag32_keyword_top",
    "rk21_opportunity_scores", "tx2_fixed_windows", "tx7_key_results", "cl1_dictionary_tags", "ql3_chunk_rubric", "gr1_threshold_pairs", "gr8_bfs",
    "tm3_gap_evolution", "set6_content_dedup", "snk1_group_replace", "st1_tumbling",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    named = queries()
    took: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(4):  # one warm-up, then the median of three
            began = time.perf_counter()
            named[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
