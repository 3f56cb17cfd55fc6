"""Function blocks send no file through the driver."""

from __future__ import annotations

from riskloom.operators import blocks as B
from riskloom.plans.fixtures import fx

from conftest import SMALL


def test_function_blocks_broadcast_nothing(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("fx_js_files", "fx_file_diffs"):
            plan = B.function_blocks(fx(spark, SMALL, name), ["file_id"])._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_short_rows_are_dealt_out_before_texts_are_made(spark):
    for name in ("fx_js_files", "fx_file_diffs", "fx_patches"):
        assert fx(spark, SMALL, name).rdd.getNumPartitions() >= 8
