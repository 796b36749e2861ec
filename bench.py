"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up; the median is reported (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "e08_uniform_bins",
    "e16_full_report",
    "e15_standard_segments",
    "p01_fraction_split",
    "q04_duplicate_keys",
    "q07_feature_matrix",
    "i07_lookup",
    "a01_strict_asof",
    "f08_shared_features",
    "r10_confidence_score",
    "w04_score_requests",
    "m06_logistic_search",
    "s07_table_fingerprint",
)


def main() -> None:
    from duelframe.registry import QUERIES, load_all
    from duelframe.session import build_session

    load_all()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus), extra={"spark.driver.memory": "16g"})
    times = {}
    for name in HEADLINE:
        runs = []
        for attempt in range(repeats + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
