"""Headline-query benchmark.

/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "headline_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query runs once to warm up, then ``$BENCH_REPEAT`` (default 3) times; the
median is reported. Execution uses the ``noop`` sink, so the whole plan runs
and nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "similar_functions_ranked",
    "similar_functions_lsh",
    "embed_hashed",
    "duplicate_clusters",
    "detect_reverts",
    "changed_functions",
    "graph_risk",
    "k_hop_dependents",
    "history_stats",
    "analyze_warnings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from riskloom.plans import catalog
    from riskloom.session import local_session

    extra = {}
    event_log = os.environ.get("BENCH_EVENT_LOG")
    if event_log:   # Spark's event log for stage/task times (tools/stage_times.py)
        os.makedirs(event_log, exist_ok=True)
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_log}
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="riskloom-bench", extra=extra)
    catalog.load_all()
    names = only or HEADLINE
    results = {}
    for name in names:
        fn = catalog.QUERIES[name]
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                runs.append(dt)
        results[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_sec", "value": round(sum(results.values()), 3), "unit": "sec",
           "queries": results, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
           "repeat": repeat}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
