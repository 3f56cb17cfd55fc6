"""Near-copy clusters lose no link."""

from __future__ import annotations

import numpy as np

from riskloom.operators import clusters as C


def test_forest_has_every_link(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([("r", i, [float(y) for y in v]) for i, v in enumerate(x)], "repo_id string, seq long, vector array<double>")
    links = x @ x.T >= 0.88
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(links, label[None, :], len(x)).min(axis=1))
    for rows, groups in ((2048, 32768), (10, 25)):
        forest = C.similarity_forest(df, threshold=0.88, block_rows=rows, group_rows=groups, dims=6)
        got = {r.node: r.component for r in C.connected_components(forest, keys=["repo_id"]).collect()}
        assert got == {i: int(label[i]) for i in range(len(x)) if (label == label[i]).sum() > 1}
