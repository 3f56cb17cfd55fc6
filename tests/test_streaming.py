"""Stream = batch: the Structured Streaming forms give the batch results."""

from __future__ import annotations

import tempfile

import pytest
import time

from pyspark.sql import functions as F

from riskloom.operators import risk as R
from riskloom.plans import catalog
from riskloom.plans.fixtures import fx, table
from riskloom.streaming import incremental as INC
from riskloom.streaming import ops as ST

from conftest import SMALL


def _chunks_to_dir(df, n_chunks: int, order_col: str, base: str) -> str:
    """Write ``df`` as ``n_chunks`` parquet files in ``order_col`` order (older files first)."""
    src = f"{base}/src"
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    step = (hi - lo) / n_chunks
    for i in range(n_chunks):
        a = lo + step * i
        b = lo + step * (i + 1)
        part = df.where((F.col(order_col) >= a) & ((F.col(order_col) < b) if i < n_chunks - 1 else F.lit(True)))
        part.coalesce(1).write.mode("overwrite").parquet(f"{base}/tmp{i}")
        # move the single file into the source folder, oldest first
        f = [p for p in _ls(df.sparkSession, f"{base}/tmp{i}") if p.endswith(".parquet")][0]
        _mv(df.sparkSession, f, f"{src}/part-{i:04d}.parquet")
        time.sleep(0.05)
    return src


def _ls(spark, path):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in fs.listStatus(p)]


def _mv(spark, a, b):
    jvm = spark._jvm
    pa, pb = jvm.org.apache.hadoop.fs.Path(a), jvm.org.apache.hadoop.fs.Path(b)
    fs = pa.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(pb.getParent())
    fs.rename(pa, pb)


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_outcome_trend_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="rl-t7-")
    ev = fx(spark, SMALL, "fx_outcome_events")
    src = _chunks_to_dir(ev, 3, "ts", base)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ST.outcome_trend_stream(stream).writeStream.format("memory").queryName("t7_out")
           .option("checkpointLocation", f"{base}/ckpt").outputMode("complete")
           .trigger(availableNow=True).start())
    q.awaitTermination(300)
    cols = ["window_start", "kind", "n_events"]
    assert _rows(spark.table("t7_out"), cols) == _rows(ST.outcome_trend(ev), cols)


@pytest.mark.parametrize("form, cols", [(ST.outcome_sliding, ["window_start", "kind", "n_events"]), (ST.outcome_sessions, ["session_start", "session_end", "kind", "n_events"])])
def test_sliding_and_session_streams_equal_batch_with_late_rows(spark, form, cols):
    base = tempfile.mkdtemp(prefix="rl-t7w-")
    ev = fx(spark, SMALL, "fx_outcome_events")
    # files in an order that is up to half a day off the event time, then rows that let the watermark pass the rest
    src = _chunks_to_dir(ev.withColumn("late", F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(43200))), 4, "late", base)
    after = ev.agg(F.max("ts").alias("m")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("m") + F.expr("interval 9 days")).cast("timestamp_ntz").alias("ts"))
    for i in range(2):
        (after.withColumn("ts", (F.col("ts") + F.expr(f"interval {i} days")).cast("timestamp_ntz")).withColumn("kind", F.lit("end"))
              .coalesce(1).write.mode("append").parquet(src))
        time.sleep(0.05)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = form.__name__
    q = (ST.windowed_stream(stream, form, watermark="1 day").writeStream.format("memory").queryName(name)
           .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(200)
    got = [r for r in _rows(spark.table(name), cols) if "end" not in r]
    assert got == _rows(form(ev), cols) and len(got) > 50


def test_outcome_log_is_order_independent(spark):
    commits = fx(spark, SMALL, "fx_commits")
    ev = fx(spark, SMALL, "fx_outcome_events")
    results = []
    for order in ("ts", "event_id"):
        base = tempfile.mkdtemp(prefix="rl-t3-")
        src = _chunks_to_dir(ev, 3, order, base)
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
        INC.outcome_log_stream(stream, log_path=f"{base}/log", checkpoint=f"{base}/ckpt").awaitTermination(300)
        view = INC.outcome_view(commits, spark.read.parquet(f"{base}/log"))
        results.append(_rows(view, ["sha", "revert_status"]))
    assert results[0] == results[1]
    # same as the batch form over the whole event table
    batch = INC.outcome_view(commits, ev)
    assert results[0] == _rows(batch, ["sha", "revert_status"])


def test_incremental_analyze_equals_replay(spark):
    base = tempfile.mkdtemp(prefix="rl-t2-")
    f = fx(spark, SMALL, "fx_functions")
    src = _chunks_to_dir(f, 3, "seq", base)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(src)
    c = fx(spark, SMALL, "fx_commits").withColumn("bug_ids", F.array_compact(F.array("bug_id")))
    q = INC.analyze_stream(stream, R.collapse_commits(c), vectors_path=f"{base}/vectors",
                           warnings_path=f"{base}/warnings", checkpoint=f"{base}/ckpt")
    q.awaitTermination(600)
    cols = ["query_seq", "match_seq", "similarity_score", "outcome", "risk_level"]
    got = _rows(spark.read.parquet(f"{base}/warnings"), cols)
    catalog.load_all()
    want = _rows(catalog.QUERIES["analyze_warnings"](spark, SMALL), cols)
    assert got == want and len(want) > 0


def test_unknown_commit_events_compat_vs_deferred(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    commits = spark.createDataFrame(
        [("r", "a1", False, t), ("r", "b2", False, t + dt.timedelta(hours=2))],
        "repo_id string, sha string, revert_status boolean, seen_at timestamp_ntz")
    log = spark.createDataFrame(
        [(1, t + dt.timedelta(hours=1), "a1", "revert", "", False, False),     # commit known: applies
         (2, t + dt.timedelta(hours=1), "b2", "revert", "", False, False),    # arrives before its commit
         (3, t + dt.timedelta(hours=3), "b2", "pull_request", "", False, False)],  # still open: no mark
        "event_id long, ts timestamp_ntz, commit_sha string, kind string, pipeline string, merged boolean, closed boolean")
    deferred = dict(INC.outcome_view(commits, log).select("sha", "revert_status").collect())
    compat = dict(INC.outcome_view(commits, log, mode="compat").select("sha", "revert_status").collect())
    assert deferred == {"a1": True, "b2": True}
    assert compat == {"a1": True, "b2": False}
    with pytest.raises(ValueError):
        INC.outcome_view(commits.drop("seen_at"), log, mode="compat")


def test_embed_once_stream_dedupes_hashes(spark):
    from riskloom.functions import scalars as S

    base = tempfile.mkdtemp(prefix="rl-t6-")
    f = (fx(spark, SMALL, "fx_functions")
         .withColumn("code_hash", S.code_hash("code_body"))
         .withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("seq")))
         .select("repo_id", "seq", "code_hash", "ts"))
    src = _chunks_to_dir(f, 2, "seq", base)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ST.embed_once_stream(stream).writeStream.format("memory").queryName("t6_out")
           .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("t6_out")
    # all rows fall inside one TTL, so each (repo, hash) passes exactly once
    assert got.count() == f.select("repo_id", "code_hash").distinct().count()
    assert got.groupBy("repo_id", "code_hash").count().where("count > 1").count() == 0
