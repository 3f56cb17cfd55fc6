"""The exact search sends a vector to few groups, and the embedding moves no text."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import vectors as V


def test_a_vector_is_sent_to_few_groups(spark):
    """A key of 100 blocks is eight ranges, so a row meets nine groups at most over both sides."""
    rows = spark.range(1600).select(F.lit("r").alias("repo_id"), F.col("id").alias("_id"), F.col("id").alias("_ord"), F.array(F.lit(1.0)).alias("_v"))
    qx, hx, grp = V._range_pairs(rows, rows, ["repo_id"], 16, 1000, ["_v"])
    assert qx.select(*grp).distinct().count() == 36
    assert qx.unionByName(hx).groupBy("_id").count().agg(F.max("count")).first()[0] == 9
    # many more rows: groups of group_rows at most
    qx, _, grp = V._range_pairs(rows, rows, ["repo_id"], 16, 100, ["_v"])
    assert qx.groupBy(*grp).count().agg(F.max("count")).first()[0] <= 125


def test_embedding_shuffles_no_text(spark):
    df = spark.createDataFrame([(1, "a b B"), (2, None), (3, "--"), (4, "x")], "id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = V.embed_hashed_sparse(df, ["id"], "text")
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = {r.id: (len(r.indices), round(sum(x * x for x in r["values"]), 9)) for r in out.collect()}
    assert got == {1: (2, 1.0), 4: (1, 1.0)}


def test_rows_of_one_id_are_one_document(spark):
    two = spark.createDataFrame([(1, "a b"), (1, "b c"), (None, "d"), (None, "d e"), (2, "z")], "id long, text string")
    one = spark.createDataFrame([(1, "a b b c"), (None, "d d e"), (2, "z")], "id long, text string")
    a, b = (sorted(((r.id or 0), r.indices, r["values"]) for r in V.embed_hashed_sparse(x, ["id"], "text").collect()) for x in (two, one))
    assert a == b and len(a) == 3
