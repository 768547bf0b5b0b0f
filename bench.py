"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then is timed end to end (planning +
execution, the result fully computed through the no-op sink) over
$BENCH_REPS runs (median). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kestrel.plans import QUERIES  # noqa: E402
from kestrel.session import build_session  # noqa: E402

HEADLINE = ["store_activity", "influence_report", "association_rules", "correlation_matrix",
            "two_way_anova", "one_way_anova", "kmeans_k_scan"]


def run_once(spark, name, sf_dir):
    t0 = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    times = {}
    for n in names:
        run_once(spark, n, sf_dir)
        times[n] = round(statistics.median(run_once(spark, n, sf_dir) for _ in range(reps)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
