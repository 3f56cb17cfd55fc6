"""Reverted neighbours by lists of a table's reverted users."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import graph as G


def test_lists_give_the_pairs_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(G, "LIST_ROWS", 3)     # a table's reverted users take several lists
    uses = spark.range(60).select(F.concat(F.lit("f"), F.col("id") % 23).alias("file_path"), F.concat(F.lit("t"), F.col("id") % 4).alias("table_name"))
    uses = uses.unionByName(uses.limit(9)).unionByName(spark.createDataFrame([("f1", None), (None, "t1")], uses.schema))
    mods = spark.range(40).select(F.concat(F.lit("commit"), F.col("id") % 13).alias("sha"), F.concat(F.lit("f"), F.col("id") % 19).alias("file_path"), (F.col("id") % 3 == 0).alias("is_reverted"))
    pairs = G.shared_reverted(uses, mods, "table_name").collect()
    want = {}
    for r in pairs:
        want.setdefault(r.file_path, set()).add(f"{r.other_file} (commit {r.reverted_sha[:7]})")
    got = {r.file_path: r.neighbors for r in G.reverted_neighbors(uses, mods).collect()}
    assert got == {f: sorted(x) for f, x in want.items()} and len(got) > 15
