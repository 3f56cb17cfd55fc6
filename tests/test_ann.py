"""The stored bucket index against the exact search."""

from __future__ import annotations

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ann as A
from riskloom.operators import clusters as C
from riskloom.operators import vectors as V
from riskloom.plans.fixtures import fx

from conftest import MEDIUM

SPARSE = ("indices", "values")


def _pairs(df):
    return {(r.query_id, r.match_id): round(r.score, 9) for r in df.collect()}


def test_recall_and_exact_scores_at_the_production_threshold(spark):
    f = fx(spark, MEDIUM, "fx_functions")
    v = V.embed_hashed_sparse(f, ["repo_id", "seq"], "code_body").checkpoint()
    plan = A.LshPlan()
    exact = _pairs(V.cosine_topk(v, threshold=0.8, k=10, sparse=SPARSE))
    got = _pairs(A.search(A.bucketed(v, plan, ["repo_id"], "seq", "seq", sparse=SPARSE, probing=True),
                          A.bucketed(v, plan, ["repo_id"], "seq", "seq", sparse=SPARSE), threshold=0.8, k=10))
    assert len(exact) > 50 and len(exact.keys() & got.keys()) >= 0.95 * len(exact)
    assert all(np.isclose(got[p], exact[p]) for p in exact.keys() & got.keys())


def test_index_is_appended_and_replaced_by_batch(spark):
    v = fx(spark, MEDIUM, "fx_vectors")
    plan, path = A.LshPlan(dims=64, bits=4, tables=3, probes=1, shards=4), tempfile.mkdtemp(prefix="rl-ann-")
    halves = [v.where(F.col("seq") % 2 == i) for i in range(2)]
    for i in (0, 1, 1):          # a batch that is written again replaces its own folder
        A.append_index(halves[i], path, plan, f"b{i}", id_col="seq", vec_col="vector")
    rows = A.read_index(spark, path)
    assert A.stored_plan(spark, path) == plan and rows.count() == 3 * v.count()
    with pytest.raises(ValueError):
        A.append_index(v, path, A.LshPlan(dims=64), "b2", id_col="seq", vec_col="vector")
    queries = A.bucketed(v, plan, ["repo_id"], "seq", "seq", vec_col="vector", probing=True)
    direct = A.bucketed(v, plan, ["repo_id"], "seq", "seq", vec_col="vector")
    want = _pairs(A.search(queries, direct, threshold=0.2, asof=True, dims=64))
    assert _pairs(A.search(queries, rows, threshold=0.2, asof=True, dims=64)) == want
    assert want and all(m < q for q, m in want)
    assert _pairs(A.search(queries, rows, threshold=0.2, asof=True, dims=64, block_rows=5)) == want
    assert A.read_index(spark, path + "/none") is None and A.stored_plan(spark, path + "/none") is None


def test_shards_that_no_query_probes_are_pruned(spark):
    v = fx(spark, MEDIUM, "fx_vectors")
    plan, path = A.LshPlan(dims=64, bits=6, tables=2, probes=0, shards=32), tempfile.mkdtemp(prefix="rl-ann-")
    A.append_index(v, path, plan, "b", id_col="seq", vec_col="vector")
    q = A.bucketed(v.where("seq = 5"), plan, ["repo_id"], "seq", "seq", vec_col="vector", probing=True)
    plan_text = A.search(q, A.read_index(spark, path), threshold=0.2, dims=64)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan_text.lower()


def test_rows_without_a_vector_match_nothing(spark):
    fns = spark.createDataFrame([("r", 1, "a b c"), ("r", 2, "a b c"), ("r", 3, "+ - ()"), ("r", 4, None)], "repo_id string, seq long, code_body string")
    v = V.embed_dedup(fns.withColumn("code_hash", F.md5("code_body")), ["repo_id"], "code_hash", "code_body")
    assert v.count() == 4
    want = {(1, 2), (2, 1)}
    assert set(_pairs(V.cosine_topk(v, threshold=0.8, sparse=SPARSE))) == want
    assert set(_pairs(V.cosine_topk(v, threshold=0.8, sparse=SPARSE, asof_col="seq"))) == {(2, 1)}
    q, h = (A.bucketed(v, A.LshPlan(), ["repo_id"], "seq", "seq", sparse=SPARSE, probing=p) for p in (True, False))
    assert set(_pairs(A.search(q, h))) == want
    s = v.withColumn("seq", F.concat(F.lit("id"), "seq"))      # ids may be strings
    assert set(_pairs(V.cosine_topk(s, threshold=0.8, sparse=SPARSE))) == {("id1", "id2"), ("id2", "id1")}


def test_a_crowded_bucket_is_cut_into_blocks(spark):
    v = spark.range(900).select(F.lit("r").alias("repo_id"), F.col("id").alias("seq"), F.array(F.lit(3), F.lit(5)).alias("indices"), F.array(F.lit(0.6), F.lit(0.8)).alias("values"))
    plan = A.LshPlan(bits=4, tables=2, probes=1)
    q, h = (A.bucketed(v, plan, ["repo_id"], "seq", "seq", sparse=SPARSE, probing=p) for p in (True, False))
    qx, hx = A.paired_blocks(q, h, ["repo_id"], 100)
    assert max(r["count"] for r in hx.groupBy(*A.GROUP).count().collect()) < 200
    got = A.search(q, h, k=3, block_rows=100).collect()
    assert len(got) == 2700 and {r.match_id for r in got if r.query_id > 5} == {0, 1, 2}


def test_stars_give_the_components_of_the_matrix():
    rng = np.random.default_rng(2)
    for _ in range(60):
        q, h = rng.choice(30, 12, replace=False), rng.choice(30, 9, replace=False)
        adjacent = rng.random((12, 9)) < 0.12
        label = {x: x for x in [*q.tolist(), *h.tolist()]}
        for _ in range(40):
            for i, j in np.argwhere(adjacent):
                label[q[i]] = label[h[j]] = min(label[q[i]], label[h[j]])
        a, b = C._stars(adjacent, q, h)
        assert dict(zip(a.tolist(), b.tolist())) == {x: y for x, y in label.items() if x != y}


def test_cluster_recall_against_all_pairs(spark):
    v = V.embed_hashed_sparse(fx(spark, MEDIUM, "fx_functions"), ["repo_id", "seq"], "code_body").checkpoint()
    links = V.cosine_topk(v, threshold=0.9, k=None, sparse=SPARSE).where("query_id < match_id").select("repo_id", F.col("query_id").alias("a"), F.col("match_id").alias("b"))
    want = C.connected_components(links, keys=["repo_id"])
    got = C.connected_components(C.similarity_forest(v, sparse=SPARSE), keys=["repo_id"])
    want, got = ({(r.node, r.component) for r in x.collect()} for x in (want, got))
    assert len(want) > 50 and len(want & got) >= 0.99 * len(want)
