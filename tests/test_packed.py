"""The exact search sends sparse vectors packed, and they come back bit by bit."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import vectors as V
from riskloom.operators.packed import pack, unpack


def _counts(rng, n: int, dims: int, most: int) -> np.ndarray:
    c = rng.integers(1, most + 1, (n, dims)) * (rng.random((n, dims)) < 0.3)
    return c / np.maximum(np.sqrt((c * c).sum(axis=1)), 1)[:, None]


@pytest.mark.parametrize("dims", [1, 7, 64, 768])
def test_packed_vectors_come_back_bit_by_bit(dims):
    rng = np.random.default_rng(dims)
    m = np.concatenate([*(_counts(rng, 20, dims, most) for most in (1, 2, 12, 300, 40_000)), rng.normal(size=(20, dims)), np.zeros((2, dims)),
                        np.full((2, dims), np.nan), np.full((2, dims), -0.5), np.full((2, dims), 5e-324)])
    m = m[rng.permutation(len(m))]
    assert unpack(pack(m), dims).tobytes() == m.tobytes()
    assert unpack([], dims).shape == (0, dims)


def test_packed_counts_take_a_tenth_of_the_arrays():
    m = _counts(np.random.default_rng(1), 50, 768, 12)
    assert 10 * sum(map(len, pack(m))) < 12 * np.count_nonzero(m)


def _texts(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("t"), (F.col("id") * i % (F.col("id") % 7 + 40)).cast("string"))))
    df = spark.range(300).select(F.concat(F.lit("r"), F.col("id") % 2).alias("repo_id"), F.col("id").alias("seq"), text.alias("text"))
    return V.embed_hashed_sparse(df, ["repo_id", "seq"], "text")


def test_no_array_of_a_sparse_vector_is_shuffled(spark):
    v = _texts(spark)
    for asof in (None, "seq"):
        top = V.cosine_topk(v, threshold=0.5, k=5, asof_col=asof, sparse=("indices", "values"))
        plan = top._jdf.queryExecution().optimizedPlan().toString()
        assert "_p#" in plan and "_x#" not in plan and "_i#" not in plan


def test_sparse_vectors_meet_fewer_groups_and_the_same_matches(spark):
    v = _texts(spark)
    rows = V.packed(v.select("repo_id", F.col("seq").alias("_id"), F.col("seq").alias("_ord"), F.col("indices").alias("_i"), F.col("values").alias("_x")), V.DIMS, 64)
    qx, hx, _ = V._range_pairs(rows, rows, ["repo_id"], 5, V.GROUP_ROWS_PACKED, ["_p"], V.GROUPS_PACKED)
    assert qx.unionByName(hx).groupBy("_id").count().agg(F.max("count")).first()[0] == V.GROUPS_PACKED + 1
    m = {r._id: unpack([bytes(r._p)], V.DIMS)[0] for r in rows.collect()}
    got = {(r.query_id, r.match_id): r.score for r in V.cosine_topk(v, threshold=0.5123, k=None, asof_col="seq", sparse=("indices", "values"), block_rows=5).collect()}
    want = {(a, b): s for a in m for b in m if b < a and a % 2 == b % 2 and (s := float(m[a] @ m[b])) >= 0.5123}
    assert want and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
