"""Warnings kept up to date by outcome events against ranking everything anew."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from riskloom.operators import risk as R
from riskloom.operators import vectors as V
from riskloom.plans.fixtures import fx
from riskloom.streaming import incremental as INC
from riskloom.streaming import maintain as M

from conftest import SMALL

COLUMNS = ["id", "query_seq", "match_seq", "outcome", "risk_level", "risk_score", "similarity_score"]


def test_late_events_give_what_a_full_recompute_gives(spark):
    base = tempfile.mkdtemp(prefix="rl-maintain-")
    fns = fx(spark, SMALL, "fx_functions").checkpoint()
    commits = (fx(spark, SMALL, "fx_commits").withColumn("bug_ids", F.array_compact(F.array("bug_id"))).drop("bug_id")
               .withColumn("revert_status", F.lit(False)).checkpoint())
    v = V.embed_hashed_sparse(fns, ["repo_id", "seq"], "code_body").checkpoint()
    top = V.cosine_topk(v, threshold=0.8, k=6, asof_col="seq", sparse=("indices", "values"))
    fetched = R.fetched_matches(top, fns).checkpoint()
    M.store_matches(fetched, R.collapse_commits(commits), fns, base, limit=3)
    first = {tuple(r) for r in M.standing_warnings(spark, base).select(*COLUMNS).collect()}
    # events of matched commits in any order, of unknown commits, open pull requests and nulls
    shas = fetched.select("commit_sha").distinct().withColumn("h", F.pmod(F.xxhash64("commit_sha"), F.lit(7)))
    ev = shas.select(F.xxhash64("commit_sha", F.lit("e")).alias("event_id"), F.when(F.col("h") < 2, "revert").when(F.col("h") == 2, "ci").when(F.col("h") == 3, "pull_request").otherwise("push").alias("kind"),
                     "commit_sha", F.lit(False).alias("merged"), (F.col("commit_sha") > "8").alias("closed"), "h")
    odd = spark.createDataFrame([(1, "revert", "unknown", False, False, 0), (2, "revert", None, False, False, 1)], ev.schema)
    ev = ev.unionByName(odd).checkpoint()
    for i, part in enumerate((ev.where("h % 2 = 0"), ev.where("h % 2 = 1"), ev.where("h = 0"))):     # the last are sent again
        part.drop("h").coalesce(1).write.mode("append").parquet(f"{base}/src/part={i}")
    stream = spark.readStream.schema(ev.drop("h").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
    q = M.maintain_stream(stream.select(*ev.drop("h").columns), commits, fns, base, f"{base}/ckpt", limit=3)
    q.awaitTermination(280)
    got = {tuple(r) for r in M.standing_warnings(spark, base).select(*COLUMNS).collect()}
    view = R.collapse_commits(INC.outcome_view(commits, ev.drop("h")))
    want = {tuple(r) for r in R.assemble_warnings(R.rerank(fetched, view, 3), fns).select(*COLUMNS).collect()}
    assert got == want and len(want) > 20 and got != first
    assert first - got                                    # some stood before and do not now, or stand otherwise
