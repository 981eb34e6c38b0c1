"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up, then ``BENCH_RUNS`` times (default 3) into
Spark's ``noop`` sink (the whole result is computed, nothing is written);
the median is reported.  ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagewright.plans.catalog import QUERIES  # noqa: E402
from pagewright.session import get_session  # noqa: E402

HEADLINE = [
    "rebuild_index", "index_job", "write_index", "embed_job", "ingest_job", "upsert_pages",
    "resolve_paths", "assign_batches", "term_vectors", "term_stats", "bm25", "phrase", "knn_exact",
    "retrieve_sources", "html_text", "followups", "dead_letters", "cascade_delete",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    times = {}
    for name in names:
        samples = []
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus, "runs": runs, "spark": spark.version,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))


if __name__ == "__main__":
    main()
