"""A crowded bucket of the index is scored in blocks inside groups; rows go to few groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import ann as A
from riskloom.plans.fixtures import fx

from conftest import MEDIUM


def test_blocks_within_groups_give_the_same_rows(spark):
    v = fx(spark, MEDIUM, "fx_vectors")
    plan = A.LshPlan(dims=64, bits=1, tables=2, probes=1)
    q, h = (A.bucketed(v, plan, ["repo_id"], "seq", "seq", vec_col="vector", probing=p).checkpoint() for p in (True, False))
    got = [sorted((r.query_id, r.match_id, r["rank"]) for r in A.search(q, h, k=5, threshold=0.1, asof=True, dims=64, block_rows=b, group_rows=g).collect())
           for b, g in ((2048, 2048), (7, 20), (7, 32768))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 50


def test_a_large_group_holds_a_whole_bucket(spark):
    v = spark.range(900).select(F.lit("r").alias("repo_id"), F.col("id").alias("seq"), F.array(F.lit(0.6), F.lit(0.8)).alias("vector"))
    q = A.bucketed(v, A.LshPlan(dims=2, bits=2, tables=3, probes=0), ["repo_id"], "seq", "seq", vec_col="vector")
    got = A.search(q, q.select("*"), k=3, threshold=0.5, dims=2, block_rows=100, group_rows=1000)
    assert got.count() == 2700
    qx, hx = A.paired_blocks(q, q.select("*"), ["repo_id"], 1000)
    assert qx.count() == hx.count() == 2700      # each row once per table, in no matter how many blocks
