"""JSON outcome-event source, model/scorer hooks, graph risk on warnings."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import hooks as HK
from riskloom.operators import risk as R
from riskloom.operators import vectors as V
from riskloom.plans.fixtures import fx
from riskloom.sources import events as EV

from conftest import SMALL

# The toy model below lives in this test module; ship it to workers by value.
from pyspark import cloudpickle  # noqa: E402
import sys  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_outcome_event_json_roundtrip(spark):
    ev = fx(spark, SMALL, "fx_outcome_events")
    pr = F.struct(F.lit(7).cast("long").alias("number"), F.col("merged"),
                  F.struct(F.col("commit_sha").alias("sha")).alias("head"))
    body = F.when(F.col("kind") == "pull_request",
                  F.to_json(F.struct("event_id", "kind", "ts", F.lit("closed").alias("action"), pr.alias("pull_request"))))
    body = body.when(F.col("kind") == "ci", F.to_json(F.struct("event_id", "kind", "ts", "commit_sha", "pipeline")))
    body = body.otherwise(F.to_json(F.struct("event_id", "kind", "ts", "commit_sha")))
    path = tempfile.mkdtemp(prefix="rl-s8-") + "/events"
    ev.select(body.alias("value")).unionByName(
        spark.createDataFrame([("{not json",)], "value string")).write.text(path)
    raw = EV.read_outcome_events(spark, path)
    bad = raw.select("event_id", "kind", "_corrupt_record").collect()
    assert sum(1 for r in bad if r["_corrupt_record"] is not None) == 1
    norm = EV.normalize_outcome_events(raw)
    got = sorted(map(tuple, norm.select("event_id", "kind", "commit_sha").collect()))
    want = sorted(map(tuple, ev.select("event_id", "kind", "commit_sha").collect()))
    assert got == want
    prs = norm.where("kind = 'pull_request'").select("event_id", "merged").collect()
    expected = dict(ev.where("kind = 'pull_request'").select("event_id", "merged").collect())
    assert all(expected[r.event_id] == r.merged for r in prs)


def _toy_model():
    dims = 16

    def encode(texts):
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, hash(w) % dims] += 1.0
        return out

    return encode


def test_model_hook_embeds_each_hash_once(spark):
    f = fx(spark, SMALL, "fx_functions").withColumn("code_hash", S.code_hash("code_body"))
    emb = HK.model_embedder(_toy_model, dims=16)
    out = V.embed_dedup(f, ["repo_id"], "code_hash", "code_body", embed=emb)
    rows = out.select("seq", "vector").collect()
    assert len(rows) == f.count()
    norms = [float(np.linalg.norm(np.asarray(r.vector, dtype=np.float64))) for r in rows]
    assert all(abs(n - 1.0) < 1e-5 or n == 0.0 for n in norms)


def test_scorer_hook_and_parse(spark):
    req = spark.createDataFrame([(1, "p1"), (2, "p2")], "rid long, prompt string")

    def reply(pdf):
        return pdf["prompt"].map(lambda p: '{"risk_level": "HIGH", "explanation": "%s"}' % p)

    r = HK.score_requests(req, reply, key_cols=["rid"])
    p = r.select("rid", S.explain_parse("reply", F.lit(0.9), F.lit("reverted")).alias("x")).orderBy("rid").collect()
    assert [(x.x.risk_level, x.x.explanation) for x in p] == [("HIGH", "p1"), ("HIGH", "p2")]


def test_graph_risk_column_on_warnings(spark):
    ranked = spark.createDataFrame(
        [("r", 2, 1, "c1", "fn", "a.py", 0.95, "reverted", 0.95)],
        "repo_id string, query_seq long, match_seq long, commit_sha string, function_name string, "
        "file_path string, score double, outcome string, risk_score double")
    queries = spark.createDataFrame([("r", 2, "c2", "g", "b.py")],
                                    "repo_id string, seq long, commit_sha string, function_name string, file_path string")
    gr = spark.createDataFrame([("b.py", 0.7)], "file_path string, graph_risk_score double")
    w = R.assemble_warnings(ranked, queries, graph_risk=gr).collect()
    assert len(w) == 1 and w[0].graph_risk_score == 0.7 and w[0].risk_level == "HIGH"


def test_backfill_batch_json_reader(spark):
    from riskloom.sources import commits as SC

    files = fx(spark, SMALL, "fx_file_diffs")
    per_commit = (files.groupBy("repo_id", "sha")
                  .agg(F.sort_array(F.collect_list(F.struct("file_idx", "file_path", F.lit("python").alias("language"),
                                                            "diff", "file_content"))).alias("d"))
                  .select("repo_id", F.struct("sha", F.lit("m").alias("message"), F.lit("a").alias("author"),
                                              F.transform("d", lambda s: s.dropFields("file_idx")).alias("diffs"))
                          .alias("c")))
    bodies = per_commit.groupBy("repo_id").agg(F.collect_list("c").alias("commits"))
    path = tempfile.mkdtemp(prefix="rl-s3-") + "/batches"
    (bodies.select(F.to_json(F.struct("repo_id", "commits")).alias("value"))
           .unionByName(spark.createDataFrame([("{broken",)], "value string")).write.text(path))
    raw = SC.read_backfill_batches(spark, path)
    rows = raw.select("repo_id", "_corrupt_record").collect()
    assert sum(1 for r in rows if r["_corrupt_record"] is not None) == 1
    good = raw.where(F.col("_corrupt_record").isNull())
    exploded = SC.explode_diffs(SC.explode_commits(good))
    assert exploded.count() == files.count()
