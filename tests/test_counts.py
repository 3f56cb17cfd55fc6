"""The exact search of hashed vectors scores whole counts, and tokens are hashed once a batch."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import vectors as V
from riskloom.operators.packed import pack


def _rows(counts: np.ndarray) -> list[bytes]:
    return pack(counts / np.sqrt((counts * counts).sum(axis=1))[:, None])


@pytest.mark.parametrize("most", [3, 60_000])      # the squares of large counts are over 2^24: double precision
@pytest.mark.parametrize("k", [3, None])
@pytest.mark.parametrize("crowded", [0, 32])
def test_scores_are_whole_dot_products_over_the_norms(monkeypatch, most, k, crowded):
    monkeypatch.setattr(V, "CROWDED", crowded)
    rng = np.random.default_rng(5)
    c = rng.integers(1, most + 1, (90, 30)) * (rng.random((90, 30)) < 0.6).astype(np.float64)
    c[:, 0] = 1
    c[40:50] = c[7]                                   # copies: ties go to the smaller id
    c[20] = 2 * c[8] if most == 3 else c[8]
    packed, ids = _rows(c), rng.permutation(90)
    order = rng.permutation(90)
    d, sq = c @ c.T, (c * c).sum(axis=1)
    s = d / np.sqrt(np.multiply.outer(sq, sq))
    make = lambda i: V.Counts([packed[x] for x in i], 30)
    for o in (None, order):
        got = sorted(zip(*(z.tolist() for z in V.best_in_group(make, make, ids, ids, o, o, k, 0.6, True, 16, 3))))
        want = []
        for a in range(90):
            found = sorted((-s[a, b], ids[b], b) for b in range(90) if b != a and s[a, b] >= 0.6 and (o is None or o[b] < o[a]))
            want += [(a, b, -v) for v, _, b in (found if k is None else found[:k])]
        assert len(got) > 100 and got == sorted(want)


def test_equal_counts_score_one_and_are_exact_in_any_block(spark):
    df = spark.range(40).select(F.lit("r").alias("repo_id"), F.col("id").alias("seq"), F.concat(F.lit("a b c d "), F.when(F.col("id") % 4 == 0, "a b c d ").otherwise("")).alias("text"))
    v = V.embed_hashed_sparse(df, ["repo_id", "seq"], "text")
    top = V.cosine_topk(v, k=5, threshold=0.9, sparse=("indices", "values"), block_rows=7).collect()
    assert {r.score for r in top} == {1.0} and all(r.match_id <= 5 for r in top) and len(top) == 200


def test_tokens_are_hashed_once_a_batch_with_the_rule_of_the_columns(spark):
    texts = ["Ab İstanbul ΣΑΣ Σ Straße naïve _x_1 ٣٤ ½ Ⅷ 漢字 a b a \U0001d518n", "", None, "... !", "x y x"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(2)
    e = V.embed_hashed_sparse(df, ["id"], "text", dims=11)
    assert "md5(" not in e._jdf.queryExecution().optimizedPlan().toString()
    token = F.explode(F.regexp_extract_all("text", F.lit(V.TOKEN_PATTERN), 0))
    want = {}
    for r in df.select("id", token.alias("t")).select("id", V.token_bucket(F.lower("t"), 11).alias("b")).collect():
        want.setdefault(r.id, {}).setdefault(r.b, 0)
        want[r.id][r.b] += 1
    got = {r.id: (r.indices, r["values"]) for r in e.collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for i, n in want.items():
        assert got[i] == (sorted(n), [n[b] / np.sqrt(sum(x * x for x in n.values())) for b in sorted(n)])
