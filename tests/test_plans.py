"""Scale guard: no registered query plans a nested-loop or cartesian join."""

from __future__ import annotations

import __spark_entry__ as E

from conftest import SMALL


def test_no_nested_loop_or_cartesian_joins(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bad = []
        for name, fn in sorted(E.queries().items()):
            plan = fn(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            if "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan:
                bad.append(name)
        assert bad == []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
