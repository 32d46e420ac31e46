"""Wall time of the headline queries: one warm-up, then the median of ``BENCH_RUNS`` runs. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "b10_filtered_search",
    "b9_search",
    "k1_ingest_to_collection",
    "x9_clean_documents",
    "x9_clean_pages",
    "e2_chunks",
    "a11_exact_duplicates",
    "j3_all_pairs_top",
    "t7_diversified",
    "b8_rank_articles",
    "r1_confidence",
    "s3_time_scan",
    "s6_pages",
    "s14_batches",
    "d8_running_count",
    "d9_first_occurrence",
    "v2_history",
    "v3_as_of",
    "j8_as_of_join",
    "c1_all_conflicts",
    "c7_newest_wins",
    "j2_fallback_lookup",
    "j9_thread_roots",
    "g1_context",
    "m2_seen_set",
)


def main() -> None:
    from tidemark.catalog import QUERIES
    from tidemark.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("bench", cores, int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name:28} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
