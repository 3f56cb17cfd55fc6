"""Vector operators: block size invariance, ties, hot repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import vectors as V
from riskloom.plans.fixtures import fx

from conftest import MEDIUM


def test_block_size_does_not_change_result(spark):
    v = fx(spark, MEDIUM, "fx_vectors")
    a = V.cosine_topk(v, key_cols=["repo_id"], threshold=0.2, k=10, block_rows=2048)
    b = V.cosine_topk(v, key_cols=["repo_id"], threshold=0.2, k=10, block_rows=17)
    cols = ["query_id", "match_id", "rank"]
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_forest_preserves_components_across_blocks(spark):
    from riskloom.operators import clusters as C

    f = fx(spark, MEDIUM, "fx_functions")
    vec = V.embed_hashed_sparse(f, ["repo_id", "seq"], "code_body")
    comps = []
    for rows in (4096, 23):
        forest = C.similarity_forest(vec, threshold=0.95, block_rows=rows, sparse=("indices", "values"))
        cc = C.connected_components(forest, keys=["repo_id"])
        comps.append(sorted(map(tuple, cc.select("repo_id", "node", "component").collect())))
    assert comps[0] == comps[1] and len(comps[0]) > 0


def test_sparse_and_dense_agree(spark):
    f = fx(spark, MEDIUM, "fx_functions").where("seq < 300")
    sp = V.embed_hashed_sparse(f, ["repo_id", "seq"], "code_body")
    de = V.embed_hashed(f, ["repo_id", "seq"], "code_body", dtype="double")
    a = V.cosine_topk(sp, key_cols=["repo_id"], threshold=0.8, k=5, sparse=("indices", "values"))
    b = V.cosine_topk(de, key_cols=["repo_id"], threshold=0.8, k=5)
    cols = ["query_id", "match_id", "rank"]
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_hot_repository_is_split_into_bounded_blocks(spark):
    """All vectors in one repository: blocks stay near block_rows, results match one block."""
    v = fx(spark, MEDIUM, "fx_vectors").withColumn("repo_id", F.lit("hot"))
    rows = 50
    blocked = V._blocked(v.select("repo_id", F.col("seq").cast("bigint").alias("_id")), ["repo_id"], "_id", rows, "b")
    sizes = [r["count"] for r in blocked.groupBy("b").count().collect()]
    assert len(sizes) == -(-v.count() // rows)          # ceil(n / block_rows) blocks
    assert max(sizes) <= 2 * rows                        # hash-assigned, bounded
    small = V.cosine_topk(v, key_cols=["repo_id"], threshold=0.2, k=10, block_rows=rows)
    one = V.cosine_topk(v, key_cols=["repo_id"], threshold=0.2, k=10, block_rows=100_000)
    cols = ["query_id", "match_id", "rank"]
    assert sorted(map(tuple, small.select(*cols).collect())) == sorted(map(tuple, one.select(*cols).collect()))


def test_ties_at_the_cut_are_decided_by_id(spark):
    """Thirty identical history vectors: the top-3 must be the three smallest ids."""
    rows = [("r", 0, [1.0, 0.0])] + [("r", i, [0.6, 0.8]) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "repo_id string, seq long, vector array<double>")
    q = df.where("seq = 0")
    got = V.cosine_topk(q, df, threshold=0.1, k=3, block_rows=8).orderBy("rank").collect()
    assert [r.match_id for r in got] == [1, 2, 3]


def test_asof_range_blocks_match_one_block(spark):
    """As-of search with many range blocks (pairs after the query range pruned) = one block."""
    v = fx(spark, MEDIUM, "fx_vectors")
    cols = ["query_id", "match_id", "rank"]
    a = V.cosine_topk(v, key_cols=["repo_id"], threshold=0.2, k=20, asof_col="seq", block_rows=13)
    b = V.cosine_topk(v, key_cols=["repo_id"], threshold=0.2, k=20, asof_col="seq", block_rows=100_000)
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_block_emits_at_most_k_per_row_under_ties():
    import numpy as np
    import pandas as pd

    fn = V._block_topk_fn(["repo_id"], k=3, threshold=0.1, asof=False, exclude_same_id=True)
    q = pd.DataFrame({"_id": [0], "_ord": [0], "_v": [np.array([1.0, 0.0])]})
    h = pd.DataFrame({"_id": list(range(40, 0, -1)), "_ord": [0] * 40, "_v": [np.array([0.6, 0.8])] * 40})
    out = fn(("r", 0, 0), q, h)
    assert sorted(out["h_id"].tolist()) == [1, 2, 3]      # exactly k, smallest ids among the ties
