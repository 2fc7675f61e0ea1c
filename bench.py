"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from shelfwise.plans import QUERIES
from shelfwise.session import local_session

HEADLINE = (
    "transactional_interactions", "products_from_transactions", "popularity", "unseen_popular", "recommend_all", "train_test_split",
    "evaluate_customers", "content_based_topk", "cf_topk", "hybrid_blend", "ranking_topk", "sim_topk_same_category", "sim_topk_global",
    "sim_dense_topk", "join_self_category_pairs", "negative_sampling", "upload_validation", "commit_replace", "profile_columns",
    "events_by_day", "ctr_by_source", "rate_limit_sliding", "stream_events_to_interactions", "stream_identity_merge",
)
ONCE = {"hybrid_blend", "ranking_topk", "cf_topk"}  # minutes-long model fits are timed once


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    run(spark, "popularity", sf_dir)  # start the JVM's and Python's workers
    times = {}
    for name in names:
        first = run(spark, name, sf_dir)
        again = [run(spark, name, sf_dir) for _ in range(0 if name in ONCE or first > 20 else runs - 1)]
        # the first run also compiles; it counts only when it is the only one
        times[name] = round(statistics.median(again) if again else first, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {}
    if "content_based_topk" in times:
        rates["customers_scored_per_sec_content"] = round(customers / times["content_based_topk"])
    if "cf_topk" in times:
        rates["customers_scored_per_sec_cf_with_fit"] = round(customers / times["cf_topk"])
    if "stream_events_to_interactions" in times:
        rates["events_ingested_per_sec"] = round(events / times["stream_events_to_interactions"])
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "rates": rates, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
