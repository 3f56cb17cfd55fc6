"""Per-key state in event-time order (T1, T5) and with expiry (T6), by ``transformWithState``.

A fold over a key's rows (the last head seen, the window of a quota) must see
them in event-time order, also where they come in several Arrow chunks or
micro-batches, or late within the watermark. ``InOrder`` keeps a key's rows in
list state until the watermark has passed them, then folds those that are due,
sorted by (time, id). One event-time timer per chunk and key wakes it; state
holds the rows within the watermark delay and the fold's value, nothing else.
Rows older than the watermark are dropped by Spark, as in any windowed stream.

``EmbedOnce`` passes a (key, hash) the first time and again after its state's
time to live has run out, which is the cache entry's lifetime on the clock.

Queries need the RocksDB state store: ``use_rocksdb(spark)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .ops import EMBED_TTL_SECONDS, QUOTA_LIMIT, QUOTA_WINDOW_SECONDS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that list state, timers and time to live need."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Folds a key's rows in (time, id) order once the watermark has passed them.

    ``fold(value, row)`` gives the new value and what to add to the row, or None
    to leave the row out; ``value`` is None for a new key.
    """

    def __init__(self, columns: list[str], row_schema: T.StructType, value_schema: T.StructType, fold: Callable, out: T.StructType):
        self.columns, self.row_schema, self.value_schema, self.fold, self.out = columns, row_schema, value_schema, fold, out

    def init(self, handle) -> None:
        self.handle = handle
        # a chunk of rows is one entry, column by column: one call to the store instead of one per row
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.row_schema]))
        self.value = handle.getValueState("value", self.value_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                got = tuple(pdf[c].tolist() for c in self.columns)
                self.waiting.appendValue(got)
                least = min(got[0])
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)   # microseconds to the next millisecond
        yield pd.DataFrame({f.name: [] for f in self.out.fields}).astype(object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for entry in self.waiting.get():
            for r in zip(*entry):
                (due if r[0] < passed else rest).append(r)
        out = []
        if due:
            if rest:
                self.waiting.put([tuple(map(list, zip(*rest)))])
                self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
            else:
                self.waiting.clear()
            value = tuple(self.value.get()) if self.value.exists() else None
            for r in sorted(due, key=lambda r: r[:2]):
                value, more = self.fold(value, r)
                if more is not None:
                    out.append((*key, *r, *more))
            self.value.update(value)
        yield pd.DataFrame(out, columns=[f.name for f in self.out.fields])

    def close(self) -> None:
        pass


def _in_order(events: DataFrame, key_col: str, id_col: str, ts_col: str, extra: list[str], fold: Callable, value_schema: T.StructType,
              more: list[T.StructField], watermark: str) -> DataFrame:
    ntz = isinstance(events.schema[ts_col].dataType, T.TimestampNTZType)
    at = F.col(ts_col).cast("timestamp")
    rows = events.select(F.col(key_col), at.alias("at_"), F.unix_micros(at).alias("us_"), F.col(id_col).cast("long").alias("id_"), *extra).withWatermark("at_", watermark)
    row_schema = T.StructType([T.StructField("us_", T.LongType()), T.StructField("id_", T.LongType()), *[T.StructField(c, events.schema[c].dataType) for c in extra]])
    out = T.StructType([T.StructField(key_col, events.schema[key_col].dataType), *row_schema.fields, *more])
    done = rows.groupBy(key_col).transformWithStateInPandas(InOrder(row_schema.names, row_schema, value_schema, fold, out), out, "Append", "EventTime")
    ts = F.timestamp_micros("us_")
    return done.select(key_col, F.col("id_").alias(id_col), (ts.cast("timestamp_ntz") if ntz else ts).alias(ts_col), *extra, *[f.name for f in more])


def head_changes_ordered(events: DataFrame, *, key_col="repo_id", head_col="head", ts_col="ts", id_col="event_id", watermark: str = "10 minutes") -> DataFrame:
    """Rows whose head differs from the key's previous one in event time."""

    def fold(value: Any, row: tuple):
        head = row[2]
        return (head,), (() if value is None or value[0] != head else None)

    state = T.StructType([T.StructField("head", events.schema[head_col].dataType)])
    return _in_order(events, key_col, id_col, ts_col, [head_col], fold, state, [], watermark)


def quota_audit_ordered(requests: DataFrame, *, key_col="api_key", ts_col="ts", id_col="event_id", limit: int = QUOTA_LIMIT,
                        window_s: int = QUOTA_WINDOW_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """T5: per request in event time, allowed? and the remaining quota of its window."""
    window_us = int(window_s * 1_000_000)

    def fold(value: Any, row: tuple):
        start, count = value if value is not None else (None, 0)
        if start is None or row[0] >= start + window_us:
            return (row[0], 1), (True, limit - 1)
        if count >= limit:
            return (start, count), (False, 0)
        return (start, count + 1), (True, limit - count - 1)

    state = T.StructType([T.StructField("start", T.LongType()), T.StructField("count", T.LongType())])
    return _in_order(requests, key_col, id_col, ts_col, [], fold, state, [T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType())], watermark)


class EmbedOnce(StatefulProcessor):
    """Passes a key's first row, and the next one after the time to live."""

    def __init__(self, names: list[str], ttl_ms: int):
        self.names, self.ttl_ms = names, ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.seen.exists()
        for pdf in rows:
            if len(pdf):
                if fresh:
                    self.seen.update((timerValues.getCurrentProcessingTimeInMs(),))
                    yield pdf[self.names].head(1)
                    fresh = False
        return

    def close(self) -> None:
        pass


def embed_once_ttl(functions: DataFrame, *, key_cols=("repo_id",), hash_col="code_hash", ttl_seconds: int = EMBED_TTL_SECONDS) -> DataFrame:
    """Each (key, code hash) once per time to live on the clock; the rows that pass are the ones to embed."""
    return (functions.groupBy(*key_cols, hash_col)
            .transformWithStateInPandas(EmbedOnce(functions.columns, max(1, int(ttl_seconds * 1000))), functions.schema, "Append", "ProcessingTime"))
