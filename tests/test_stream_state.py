"""Ordered and expiring stream state against the batch forms."""

from __future__ import annotations

import datetime as dt
import random
import tempfile
import time

import pytest

from riskloom.streaming import ops as ST
from riskloom.streaming import state as SS

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(SS.PROVIDER)
    SS.use_rocksdb(spark)
    yield spark
    spark.conf.set(SS.PROVIDER, before)


def _run(spark, files, schema, name, operator, clock=False):
    """The operator over ``files`` (lists of rows), one micro-batch each. By the clock a query has no end of its own."""
    base = tempfile.mkdtemp(prefix="rl-state-")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/src/b={i}")
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{base}/src")
    w = operator(stream.drop("b")).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{base}/ckpt").outputMode("append")
    q = w.trigger(processingTime="1 second").start() if clock else w.trigger(availableNow=True).start()
    if clock:
        end = time.time() + 60
        while time.time() < end and sum(p.numInputRows for p in q.recentProgress) < sum(map(len, files)):
            time.sleep(0.5)
    else:
        q.awaitTermination(200)
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def _shuffled(rows, files, lag_rows, seed):
    """Rows with bounded disorder, dealt to ``files`` batches, and one far later row that lets the watermark pass all."""
    rng = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda i: i + rng.random() * lag_rows)
    size = -(-len(rows) // files)
    return [[rows[i] for i in order[k * size:(k + 1) * size]] for k in range(files)]


def test_hot_key_out_of_order_heads_equal_batch(rocks):
    rng = random.Random(1)
    rows = [("hot", i, T0 + dt.timedelta(seconds=i), rng.choice("abc")) for i in range(12_000)]
    rows += [(f"k{i % 5}", 20_000 + i, T0 + dt.timedelta(seconds=37 * i), rng.choice("ab")) for i in range(300)]
    rows.sort(key=lambda r: r[2])
    schema = "repo_id string, event_id long, ts timestamp_ntz, head string"
    files = [*_shuffled(rows, 1, 60, 2), [("end", 10**6, T0 + dt.timedelta(days=9), "z")], [("end", 10**6 + 1, T0 + dt.timedelta(days=10), "z")]]
    got = _run(rocks, files, schema, "t1_ordered", lambda s: SS.head_changes_ordered(s, watermark="5 minutes"))
    want = ST.head_changes(rocks.createDataFrame(rows, schema)).select("repo_id", "event_id", "ts", "head").collect()
    assert sorted(r for r in got if r[0] != "end") == sorted(map(tuple, want)) and len(want) > 5000


def test_quota_across_late_batches_equals_batch(rocks):
    rng = random.Random(3)
    rows = [(f"k{rng.choice([0, 0, 0, 1, 2])}", i, T0 + dt.timedelta(seconds=3 * i)) for i in range(900)]
    schema = "api_key string, event_id long, ts timestamp_ntz"
    files = [*_shuffled(rows, 3, 20, 4), [("end", 10**6, T0 + dt.timedelta(days=9))], [("end", 10**6 + 1, T0 + dt.timedelta(days=10))]]
    got = _run(rocks, files, schema, "t5_ordered", lambda s: SS.quota_audit_ordered(s, limit=4, window_s=60, watermark="5 minutes"))
    want = ST.quota_audit(rocks.createDataFrame(rows, schema), limit=4, window_s=60).select("api_key", "event_id", "ts", "allowed", "remaining").collect()
    assert sorted(r for r in got if r[0] != "end") == sorted(map(tuple, want)) and any(not r.allowed for r in want)


def test_hashes_pass_again_after_their_time_to_live(rocks):
    schema = "repo_id string, code_hash string, seq long"
    files = [[("r", "a", 1), ("r", "a", 2), ("r", "b", 3)], [("r", "a", 4), ("q", "a", 5)]]
    long = _run(rocks, files, schema, "t6_long", lambda s: SS.embed_once_ttl(s, ttl_seconds=3600), clock=True)
    assert sorted(r[:2] for r in long) == [("q", "a"), ("r", "a"), ("r", "b")]
    short = _run(rocks, files, schema, "t6_short", lambda s: SS.embed_once_ttl(s, ttl_seconds=0.001), clock=True)
    assert sorted(r[:2] for r in short) == [("q", "a"), ("r", "a"), ("r", "a"), ("r", "b")]
