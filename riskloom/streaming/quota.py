"""Exact, skew-resistant batch quota audit (T5).

The rule: per key, a window opens at a request when no window is open and
lasts ``W``; the first ``limit`` requests of a window are allowed, the rest
rejected (rejections do not extend it). So window starts form a chain: the
first request of the key, then ``nxt(s)`` = the first request at or after
``ts_s + W``, and so on.

Everything below is keyed by request id or by (key, time bucket), never by
the key alone, so a key holding a third of all requests is spread over many
tasks:

1. ``nxt`` for every request: an as-of lookup "first request at or after
   t + W", done inside (key, bucket) partitions with a running window, and
   for probes whose bucket holds no answer, through the tiny table of the
   first request per non-empty (key, bucket).
2. chain marking by pointer doubling: ``M <- M ∪ J(M)``, ``J <- J∘J``; after
   round k, M holds the first 2^k window starts of every key. Each round is a
   pair of joins on request id, checkpointed; log2(longest chain) rounds.
3. every request's window = the last window start at or before it (the same
   bucketed as-of, backwards).
4. the first ``limit`` requests of each window by ``row_number() <= limit``,
   planned as a partial window-group limit (at most ``limit`` rows per window
   per task); everything else is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def _asof(points: DataFrame, probes: DataFrame, *, key: str, bucket_us: int, forward: bool) -> DataFrame:
    """For every probe (key, pid, p): the first point (key, t, id) with
    (t, id) >= (p, -inf) when ``forward`` else the last point with t <= p
    (ties: smallest id going forward, largest going back). Returns (pid, id, t)."""
    pts = points.select(key, "t", "id", F.floor(F.col("t") / bucket_us).alias("b"),
                        F.lit(0).alias("is_probe"), F.lit(None).cast("long").alias("pid"))
    prb = probes.select(key, F.col("p").alias("t"), F.lit(None).cast("long").alias("id"),
                        F.floor(F.col("p") / bucket_us).alias("b"), F.lit(1).alias("is_probe"), "pid")
    u = pts.unionByName(prb)
    if forward:
        # walk time descending: requests before probes at equal time, smaller ids last
        order = [F.desc("t"), F.asc("is_probe"), F.desc("id")]
    else:
        # walk time ascending: requests before probes at equal time, larger ids last
        order = [F.asc("t"), F.asc("is_probe"), F.asc("id")]
    w = Window.partitionBy(key, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("is_probe") == 0, F.struct("t", "id")), ignorenulls=True).over(w)
    r = u.withColumn("_hit", seen).where("is_probe = 1").select(key, "pid", "b", "_hit")
    inside = r.where(F.col("_hit").isNotNull()).select("pid", F.col("_hit.id").alias("id"), F.col("_hit.t").alias("t"))
    # probes with no answer in their bucket: the next (previous) non-empty bucket
    miss = r.where(F.col("_hit").isNull())
    edge = F.min if forward else F.max
    per_b = points.groupBy(key, F.floor(F.col("t") / bucket_us).alias("b")).agg(
        edge(F.struct("t", "id")).alias("_e"))
    mb = miss.select(key, "b").distinct()
    ub = (per_b.select(key, "b", F.lit(0).alias("is_probe"), "_e")
               .unionByName(mb.select(key, "b", F.lit(1).alias("is_probe"), F.lit(None).alias("_e"))))
    # the probe sorts before its own bucket's row: only strictly later (earlier) buckets count
    ob = [F.desc("b"), F.desc("is_probe")] if forward else [F.asc("b"), F.desc("is_probe")]
    wb = Window.partitionBy(key).orderBy(*ob).rowsBetween(Window.unboundedPreceding, -1)
    nb = (ub.withColumn("_n", F.last("_e", ignorenulls=True).over(wb)).where("is_probe = 1")
            .select(key, "b", "_n"))
    across = (miss.join(nb, [key, "b"]).where(F.col("_n").isNotNull())
                  .select("pid", F.col("_n.id").alias("id"), F.col("_n.t").alias("t")))
    return inside.unionByName(across)


def quota_audit_split(requests: DataFrame, *, key_col="api_key", ts_col="ts", id_col="event_id",
                      limit: int = 200, window_s: int = 60, bucket_s: int | None = None) -> DataFrame:
    """(key, id, ts, allowed, remaining, window_start) for every request; ids unique."""
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    W = int(window_s * 1_000_000)
    B = int((bucket_s if bucket_s else min(window_s, 60)) * 1_000_000)
    ntz = isinstance(requests.schema[ts_col].dataType, T.TimestampNTZType)
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    micros = (F.expr(f"timestampdiff(MICROSECOND, {epoch}, `{ts_col}`)") if ntz
              else F.unix_micros(F.col(ts_col)))
    r = requests.select(F.col(key_col).alias("k"), F.col(id_col).cast("long").alias("id"),
                        F.col(ts_col).alias("ts"), micros.alias("t"))
    r = r.checkpoint()
    pts = r.select("k", "t", "id")
    # 1. successor window start candidate of every request
    nxt = _asof(pts, r.select("k", F.col("id").alias("pid"), (F.col("t") + W).alias("p")),
                key="k", bucket_us=B, forward=True)
    J = nxt.select(F.col("pid").alias("id"), F.col("id").alias("to")).checkpoint()
    # 2. chain marking by pointer doubling, seeded with each key's first request
    M = (r.groupBy("k").agg(F.min(F.struct("t", "id")).alias("_f"))
          .select(F.col("_f.id").alias("id"))).checkpoint()
    while True:  # each round doubles the reach: it ends after log2(longest chain) rounds
        step = M.join(J, "id").select(F.col("to").alias("id"))
        new = step.join(M, "id", "left_anti").distinct().checkpoint()
        if new.limit(1).count() == 0:
            break
        M = M.unionByName(new).checkpoint()
        J = (J.alias("a").join(J.alias("b"), F.col("a.to") == F.col("b.id"))
              .select(F.col("a.id").alias("id"), F.col("b.to").alias("to")).checkpoint())
    starts = r.join(M, "id", "left_semi").select("k", "t", "id")
    # 3. window of every request: last start at or before it
    win = _asof(starts, r.select("k", F.col("id").alias("pid"), F.col("t").alias("p")),
                key="k", bucket_us=B, forward=False)
    win = win.select(F.col("pid").alias("id"), F.col("id").alias("start_id"), F.col("t").alias("start_t"))
    rw = r.join(win, "id")
    # 4. first `limit` requests per window
    w = Window.partitionBy("k", "start_id").orderBy("t", "id")
    first = (rw.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
               .select("id", "pos"))
    out = rw.join(first, "id", "left")
    return out.select(
        F.col("k").alias(key_col), F.col("id").alias(id_col), F.col("ts").alias(ts_col),
        F.col("pos").isNotNull().alias("allowed"),
        F.when(F.col("pos").isNotNull(), F.lit(limit) - F.col("pos")).otherwise(F.lit(0)).cast("long").alias("remaining"),
        (F.expr(f"timestampadd(MICROSECOND, start_t, {epoch})") if ntz
         else F.timestamp_micros("start_t")).alias("window_start"))
