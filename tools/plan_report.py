"""Summarise the physical plans of registered queries.

Usage: python tools/plan_report.py [sf_dir] [key ...]

Per query: shuffle exchanges, broadcast exchanges, partial window-group
limits (top-k limited before the shuffle), Python operators, scans with
pushed filters, and any nested-loop / cartesian join (there should be none).
Plans are taken with AQE off so the static plan is shown.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.plans import catalog  # noqa: E402
from riskloom.session import local_session  # noqa: E402

BENCH = ["similar_functions_ranked", "similar_functions_lsh", "embed_hashed", "duplicate_clusters",
         "detect_reverts", "changed_functions", "graph_risk", "k_hop_dependents", "history_stats",
         "analyze_warnings", "quota_audit", "head_changes", "warning_at_line"]


def summarise(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "reused": plan.count("ReusedExchange"),
        "partial_topk": len(re.findall(r"WindowGroupLimit .*Partial", plan)),
        "python": len(re.findall(r"FlatMapCoGroupsInPandas|MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython", plan)),
        "nested_loop_or_cartesian": len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan)),
        "scans_with_pushed_filters": len(re.findall(r"DataFilters: \[[^\]]", plan)),
    }


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session(8, 16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    catalog.load_all()
    keys = args or BENCH
    print("| query | shuffles | broadcasts | reused | partial top-k | python ops | NLJ/cartesian | scans w/ filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for k in keys:
        df = catalog.QUERIES[k](spark, sf_dir)
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{k}` | {s['shuffles']} | {s['broadcasts']} | {s['reused']} | {s['partial_topk']} | "
              f"{s['python']} | {s['nested_loop_or_cartesian']} | {s['scans_with_pushed_filters']} |")
    spark.stop()


if __name__ == "__main__":
    main()
