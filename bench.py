"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (comma-separated names).
"""
from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from rolewright.plans.registry import QUERIES

HEADLINE = (
    "bm25_topk", "tfidf_cosine_topk", "hybrid_shortlist", "dense_maxsim", "skill_overlap_triage", "title_match_triage", "mention_counts",
    "phrase_mentions", "evidence_join", "term_alignments", "draft_problems", "language_confusion", "redaction_counts", "corpus_normalise_stats",
    "page_lines", "token_counts", "requirement_cap", "posting_facts", "cv_units", "ndcg_by_source", "coverage_fit", "final_rank", "learn_next",
    "verdict_counts", "skill_demand", "evidence_guard", "experience_months", "pool_merge", "saved_upsert", "feed_greenhouse", "feed_lever",
    "stage_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rolewright-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": int(cpus)}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
