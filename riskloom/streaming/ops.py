"""Stream behaviours of the reference (T1–T7), each in a batch and a
Structured Streaming form.

* T1 ``head_changes``: act only when a repository's head differs from the last
  one seen. Batch: ``lag`` split by time bucket so one hot repository is spread
  over many window partitions; the first row of each bucket is fixed up from
  the previous non-empty bucket (a per-bucket aggregate, tiny).
  Stream: ``state.head_changes_ordered``.
* T5 ``quota_audit``: N requests per 60 s window anchored at the first request
  of the window; rejected requests do not extend it. The window start depends
  on the previous window, so this is arbitrary state, not ``window()``.
  Batch (default ``method='split'``, ``streaming/quota.py``): window starts are
  a chain found by pointer doubling over request ids, so a hot key is spread
  over many tasks. ``method='scan'``: rows sorted by (key, time) inside hash
  partitions and scanned by ``mapInPandas`` with the state carried across
  Arrow batches (memory bounded, but one key is one sequential scan).
  Stream: ``state.quota_audit_ordered``.
* T6 ``cache_valid``: TTL validity as of a given instant.
* T7 ``outcome_trend``: daily counts per event kind, ``outcome_sliding`` in
  overlapping windows, ``outcome_sessions`` in sessions that end after a gap; the
  stream form of each adds a watermark so old windows are finalised and their
  state dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Request quota per key and window, cache lifetimes.
QUOTA_LIMIT = 200
QUOTA_WINDOW_SECONDS = 60
EMBED_TTL_SECONDS = 86400
EXPLAIN_TTL_SECONDS = 3600


# ------------------------------------------------------------------ T1 -----
def head_changes(events: DataFrame, *, key_col="repo_id", head_col="head", ts_col="ts",
                 id_col="event_id", bucket: str = "1 hour") -> DataFrame:
    """Rows whose head differs from the previous row of the same key (the first row counts)."""
    b = F.date_trunc({"1 hour": "hour", "1 day": "day", "1 minute": "minute"}[bucket], ts_col)
    x = events.withColumn("_b", b)
    order = [F.col(ts_col), F.col(id_col)]
    w = Window.partitionBy(key_col, "_b").orderBy(*order)
    x = x.withColumn("_prev", F.lag(head_col).over(w)).withColumn("_pos", F.row_number().over(w))
    # last head of every (key, bucket), then the previous non-empty bucket's last head
    last = (x.groupBy(key_col, "_b")
             .agg(F.max_by(F.col(head_col), F.struct(*order)).alias("_last")))
    wb = Window.partitionBy(key_col).orderBy("_b")
    carry = last.select(key_col, "_b", F.lag("_last").over(wb).alias("_carry"))
    x = x.join(carry, [key_col, "_b"], "left")
    prev = F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    return (x.where(prev.isNull() | (prev != F.col(head_col)))
             .drop("_b", "_prev", "_pos", "_carry"))


# ------------------------------------------------------------------ T5 -----
def _quota_scan(key_col, ts_col, limit, window_s):
    window_us = int(window_s * 1_000_000)

    def run(batches):
        cur_key, start, count = object(), None, 0
        for pdf in batches:
            keys = pdf[key_col].to_numpy()
            us = pdf[ts_col].to_numpy(dtype="datetime64[us]").astype("int64")
            allowed, remaining, wstart = [], [], []
            for k, t in zip(keys.tolist(), us.tolist()):
                if k != cur_key:
                    cur_key, start, count = k, None, 0
                if start is None or t >= start + window_us:
                    start, count = t, 1
                    allowed.append(True)
                    remaining.append(limit - 1)
                elif count >= limit:
                    allowed.append(False)
                    remaining.append(0)
                else:
                    count += 1
                    allowed.append(True)
                    remaining.append(limit - count)
                wstart.append(start)
            out = pdf.copy()
            out["allowed"] = allowed
            out["remaining"] = pd.Series(remaining, dtype="int64").to_numpy()
            out["window_start"] = pd.to_datetime(pd.Series(wstart, dtype="int64"), unit="us").to_numpy()
            yield out

    return run


def quota_audit(requests: DataFrame, *, key_col="api_key", ts_col="ts", id_col="event_id",
                limit: int = QUOTA_LIMIT, window_s: int = QUOTA_WINDOW_SECONDS,
                num_partitions: int | None = None, method: str = "split") -> DataFrame:
    """T5 batch: per request, allowed?, remaining quota and its window start."""
    if method == "split":
        from .quota import quota_audit_split

        return quota_audit_split(requests, key_col=key_col, ts_col=ts_col, id_col=id_col,
                                 limit=limit, window_s=window_s)
    cols = [key_col, id_col, ts_col]
    src = requests.select(*cols)
    part = src.repartition(num_partitions, key_col) if num_partitions else src.repartition(key_col)
    ordered = part.sortWithinPartitions(key_col, ts_col, id_col)
    schema = T.StructType([requests.schema[c] for c in cols] + [
        T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType()),
        T.StructField("window_start", T.TimestampNTZType())])
    return ordered.mapInPandas(_quota_scan(key_col, ts_col, limit, window_s), schema)


# ------------------------------------------------------------------ T6 -----
def cache_valid(entries: DataFrame, as_of, *, key_cols=("key",), ts_col="ts",
                ttl_seconds: int = EMBED_TTL_SECONDS) -> DataFrame:
    """Latest write per cache key and whether it is still alive at ``as_of``.

    ``as_of`` is a Column (e.g. a scalar subquery, ``df.agg(...).scalar()``)
    or a literal; a one-row DataFrame with column ``as_of`` is also accepted.
    """
    keys = list(key_cols)
    last = entries.groupBy(*keys).agg(F.max(ts_col).alias("last_set"))
    if isinstance(as_of, DataFrame):
        as_of = as_of.select("as_of").scalar()
    expires = F.col("last_set") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    return last.select(*keys, "last_set", (expires > as_of).alias("valid"))


# ------------------------------------------------------------------ T7 -----
def outcome_trend(events: DataFrame, *, ts_col="ts", kind_col="kind", every: str = "1 day") -> DataFrame:
    return (events.groupBy(F.window(ts_col, every).alias("w"), kind_col)
                  .agg(F.count(F.lit(1)).alias("n_events"))
                  .select(F.col("w.start").alias("window_start"), kind_col, "n_events"))


def outcome_sliding(events: DataFrame, *, ts_col="ts", kind_col="kind", length: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """Counts per kind in windows of ``length`` that start every ``slide``."""
    return (events.groupBy(F.window(ts_col, length, slide).alias("w"), kind_col)
                  .agg(F.count(F.lit(1)).alias("n_events"))
                  .select(F.col("w.start").alias("window_start"), kind_col, "n_events"))


def outcome_sessions(events: DataFrame, *, ts_col="ts", kind_col="kind", gap: str = "1 hour") -> DataFrame:
    """Runs of events of a kind with less than ``gap`` between neighbours; a session ends ``gap`` after its last event.

    ``session_window`` merges partial sessions map-side, so a kind that holds most rows is not one task's sort of them all.
    """
    return (events.groupBy(F.session_window(ts_col, gap).alias("w"), kind_col)
                  .agg(F.count(F.lit(1)).alias("n_events"))
                  .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), kind_col, "n_events"))


def windowed_stream(events: DataFrame, batch_form, *, ts_col="ts", watermark: str = "1 day", **settings) -> DataFrame:
    """The streaming form of a batch form above; watermarks need TIMESTAMP, so a TIMESTAMP_NTZ
    event time is read as UTC (the session time zone) and the window bounds cast back."""
    ntz = isinstance(events.schema[ts_col].dataType, T.TimestampNTZType)
    ev = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")) if ntz else events
    out = batch_form(ev.withWatermark(ts_col, watermark), ts_col=ts_col, **settings)
    bounds = [c for c in ("window_start", "session_start", "session_end") if c in out.columns]
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in bounds}) if ntz else out


def outcome_trend_stream(events: DataFrame, *, ts_col="ts", kind_col="kind", every: str = "1 day",
                         watermark: str = "1 day") -> DataFrame:
    """Streaming T7."""
    return windowed_stream(events, outcome_trend, ts_col=ts_col, kind_col=kind_col, every=every, watermark=watermark)


# ------------------------------------------------------------- T6 + E5 -----
def embed_once_stream(functions: DataFrame, *, key_cols=("repo_id",), hash_col="code_hash",
                      ts_col="ts", ttl: str = "24 hours") -> DataFrame:
    """Streaming embedding cache: pass each (key, code hash) once while its
    state lives; the watermark drops the state ``ttl`` after the event time,
    so a hash seen again later is embedded again (the cache entry expired).
    The rows that pass are the ones to embed."""
    ntz = isinstance(functions.schema[ts_col].dataType, T.TimestampNTZType)
    f = functions.withColumn(ts_col, F.col(ts_col).cast("timestamp")) if ntz else functions
    return f.withWatermark(ts_col, ttl).dropDuplicatesWithinWatermark([*key_cols, hash_col])
