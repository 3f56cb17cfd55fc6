"""Batch forms of the stream behaviours (T1, T5, T6, T7); the streaming forms
are exercised in tests/test_streaming.py against these."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..streaming import ops as ST
from .catalog import query
from .fixtures import cte, fx, table

# The events table has ~one event per user every few hours, so the registered
# quota audit uses 3 requests per day to exercise the rule; the operator's
# defaults are the reference's 200 per 60 s.
AUDIT_LIMIT = 3
AUDIT_WINDOW_S = 86400


@query("head_changes", """
SELECT user_id AS repo_id, event_id, ts, event_type AS head FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) t
WHERE prev IS NULL OR prev <> event_type
""")
def head_changes(spark, sf_dir):
    """Events whose head (event type) differs from the key's previous one."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id"), "event_id", "ts",
                                              F.col("event_type").alias("head"))
    return ST.head_changes(e)


@query("quota_audit", f"""
WITH RECURSIVE r0 AS (SELECT user_id AS api_key, event_id, ts,
                        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s(api_key, rn, event_id, ts, window_start, cnt, allowed, remaining) AS (
  SELECT api_key, rn, event_id, ts, ts, 1, true, {AUDIT_LIMIT - 1} FROM r0 WHERE rn = 1
  UNION ALL
  SELECT r0.api_key, r0.rn, r0.event_id, r0.ts,
    CASE WHEN r0.ts >= s.window_start + INTERVAL {AUDIT_WINDOW_S} SECOND THEN r0.ts ELSE s.window_start END,
    CASE WHEN r0.ts >= s.window_start + INTERVAL {AUDIT_WINDOW_S} SECOND THEN 1
         WHEN s.cnt >= {AUDIT_LIMIT} THEN s.cnt ELSE s.cnt + 1 END,
    CASE WHEN r0.ts >= s.window_start + INTERVAL {AUDIT_WINDOW_S} SECOND THEN true
         WHEN s.cnt >= {AUDIT_LIMIT} THEN false ELSE true END,
    CASE WHEN r0.ts >= s.window_start + INTERVAL {AUDIT_WINDOW_S} SECOND THEN {AUDIT_LIMIT - 1}
         WHEN s.cnt >= {AUDIT_LIMIT} THEN 0 ELSE {AUDIT_LIMIT} - s.cnt - 1 END
  FROM s JOIN r0 ON r0.api_key = s.api_key AND r0.rn = s.rn + 1)
SELECT api_key, event_id, allowed, CAST(remaining AS BIGINT) AS remaining, window_start FROM s
""")
def quota_audit(spark, sf_dir):
    """T5: per-key request quota with windows anchored at the first request."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("api_key"), "event_id", "ts")
    r = ST.quota_audit(e, limit=AUDIT_LIMIT, window_s=AUDIT_WINDOW_S)
    return r.select("api_key", "event_id", "allowed", "remaining", "window_start")


@query("cache_valid", """
SELECT user_id, event_type, max(ts) AS last_set,
  max(ts) + INTERVAL 86400 SECOND > (SELECT max(ts) FROM events) AS valid
FROM events GROUP BY user_id, event_type
""")
def cache_valid(spark, sf_dir):
    """Latest write per (user, type) key alive for 24 h as of the newest event."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).scalar()          # scalar subquery: computed once, no join
    return ST.cache_valid(e, now, key_cols=["user_id", "event_type"])


@query("outcome_trend", cte("fx_outcome_events") + """
SELECT date_trunc('day', ts) AS window_start, kind, count(*) AS n_events FROM fx_outcome_events GROUP BY ALL
""")
def outcome_trend(spark, sf_dir):
    """Daily outcome-event counts per kind (tumbling windows)."""
    return ST.outcome_trend(fx(spark, sf_dir, "fx_outcome_events"))


@query("outcome_sliding", cte("fx_outcome_events") + """
SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS window_start, kind, count(*) AS n_events
FROM fx_outcome_events, range(4) r(k) GROUP BY ALL
""")
def outcome_sliding(spark, sf_dir):
    """Outcome-event counts per kind in days that start every six hours."""
    return ST.outcome_sliding(fx(spark, sf_dir, "fx_outcome_events"))


@query("outcome_sessions", cte("fx_outcome_events") + """,
g AS (SELECT kind, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY kind ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM fx_outcome_events),
s AS (SELECT kind, ts, sum(opens) OVER (PARTITION BY kind ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, kind, count(*) AS n_events FROM s GROUP BY kind, nth
""")
def outcome_sessions(spark, sf_dir):
    """Runs of outcome events of a kind with less than an hour between them."""
    return ST.outcome_sessions(fx(spark, sf_dir, "fx_outcome_events"))


@query("parse_timestamps", """
SELECT event_id,
  epoch_us(TRY_CAST(regexp_replace(concat(replace(CAST(ts AS VARCHAR), ' ', 'T'), 'Z'), 'Z$', '+00:00') AS TIMESTAMPTZ)) AS iso_us,
  TRY_CAST(regexp_replace(props, 'Z$', '+00:00') AS TIMESTAMPTZ) IS NULL AS props_unparsed
FROM events
""")
def parse_timestamps(spark, sf_dir):
    """F16: ISO-8601 texts with a trailing Z parse to the instant; non-dates give null."""
    e = table(spark, sf_dir, "events")
    iso = F.concat(F.regexp_replace(F.col("ts").cast("string"), " ", "T"), F.lit("Z"))
    return e.select("event_id", F.unix_micros(S.parse_iso_timestamp(iso)).alias("iso_us"),
                    S.parse_iso_timestamp("props").isNull().alias("props_unparsed"))
