"""Keyed tables: upsert, delete, compaction."""

from __future__ import annotations

import tempfile

from riskloom.sources import keyed as K

SCHEMA = "repo_id string, sha string, reverted boolean, seq long"
KEYS, SCOPE = ["repo_id", "sha"], ["repo_id"]


def _rows(spark, path):
    return sorted(map(tuple, K.read(spark, path, KEYS, "seq", SCOPE).select("repo_id", "sha", "reverted", "seq").collect()))


def test_last_write_wins_deletes_hide_and_compaction_keeps_the_rows(spark):
    path = tempfile.mkdtemp(prefix="rl-keyed-") + "/t"
    put = lambda name, rows: K.upsert(spark.createDataFrame(rows, SCHEMA), path, KEYS, name, buckets=4)
    assert K.read(spark, path, KEYS, "seq", SCOPE) is None and K.compact(spark, path, KEYS, "seq", SCOPE) == 0
    put("a", [("r1", f"c{i}", False, i) for i in range(20)] + [("r2", "x", False, 3), ("r2", "x", False, 3)])
    put("b", [("r1", "c3", True, 30), ("r1", "c4", True, 1)])          # a flipped flag; a late copy of lower order
    put("b", [("r1", "c3", True, 30), ("r1", "c4", True, 1)])          # the batch is run again
    want = sorted([("r1", f"c{i}", i == 3, 30 if i == 3 else i) for i in range(20)] + [("r2", "x", False, 3)])
    assert _rows(spark, path) == want
    K.delete(spark.createDataFrame([("r2", 10)], "repo_id string, seq long"), path, "d1")
    want = [r for r in want if r[0] != "r2"]
    assert _rows(spark, path) == want
    put("c", [("r2", "x", True, 11), ("r2", "y", False, 9)])           # sent again after, and sent again from before
    want = sorted([*want, ("r2", "x", True, 11)])
    assert _rows(spark, path) == want
    assert K.compact(spark, path, KEYS, "seq", SCOPE) == 3 and K._folders(spark, f"{path}/deleted") == []
    assert _rows(spark, path) == want and len(K._folders(spark, f"{path}/segments")) == 1
    put("d", [("r1", "c0", True, 50)])
    assert _rows(spark, path)[0] == ("r1", "c0", True, 50)


def test_a_compaction_that_stops_half_way_changes_no_row(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="rl-keyed-") + "/t"
    for i in range(3):
        K.upsert(spark.createDataFrame([("r1", "a", False, i), ("r2", f"b{i}", False, i)], SCHEMA), path, KEYS, f"s{i}", buckets=2)
    K.delete(spark.createDataFrame([("r2", 1)], "repo_id string, seq long"), path, "d")
    want, calls, remove = _rows(spark, path), [], K._remove

    def stops(spark, at):
        if len(calls) == 2:
            raise RuntimeError("lost")
        calls.append(at)
        remove(spark, at)

    monkeypatch.setattr(K, "_remove", stops)
    try:
        K.compact(spark, path, KEYS, "seq", SCOPE)
    except RuntimeError:
        pass
    assert _rows(spark, path) == want == [("r1", "a", False, 2), ("r2", "b2", False, 2)]
