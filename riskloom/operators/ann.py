"""Approximate cosine top-k over a stored bucket index.

Each vector gets one bucket in each of ``tables`` tables: the sign bits of its
projections on random planes. The planes are the signs of md5 digests of (seed,
table, bit, dimension), so every engine draws the same ones. The index is a
Parquet table with a row per vector and table, laid out by (batch, shard), where
the shard is a hash of (key, bucket): a batch is appended as one folder and
replaced as one if it is written again, and a search reads only the shards that
its queries probe.

A query probes its own bucket and those that differ in one of its ``probes``
least certain bits. Each (key, bucket) is scored exactly in blocks by the same
matrix product as the exact search, keeps at most k rows per query, and the
buckets' rows are merged per query: scores and order are exact, only recall is
approximate. Small buckets are scored many to a group; those with more than ``group_rows`` rows are cut into blocks of
that many, so copies of one vector that fill a bucket are many bounded tasks; their list, at
most rows / ``group_rows`` entries, is all that is joined to the vectors. A worker scores
``block_rows`` by ``block_rows`` of them at a time and gives k rows per query and block.

Rows without a vector (null, or no non-zero entry) are in no bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import read_if_written
from .vectors import DEFAULT_LIMIT, DEFAULT_THRESHOLD, DIMS, GROUP_ROWS, _matrix, _vec_cols, best_in_block, best_in_group, few, has_vector, vector_id

@dataclass(frozen=True)
class LshPlan:
    """Bits and tables of the index. At cosine s a bit agrees with probability 1 - arccos(s) / pi."""

    dims: int = DIMS
    bits: int = 8
    tables: int = 10
    probes: int = 3
    seed: int = 7
    shards: int = 64

    def least_recall(self, cosine: float) -> float:
        """Share of pairs at ``cosine`` that meet in their own buckets alone; probing finds more."""
        return 1 - (1 - (1 - np.arccos(cosine) / np.pi) ** self.bits) ** self.tables


@lru_cache
def planes(plan: LshPlan) -> np.ndarray:
    """(dims, tables * bits) of +1 and -1."""
    said = (hashlib.md5(f"{plan.seed}:{t}:{b}:{d}".encode()).hexdigest()[0] for d in range(plan.dims) for t in range(plan.tables) for b in range(plan.bits))
    return np.fromiter((1 if x >= "8" else -1 for x in said), np.int8, plan.dims * plan.tables * plan.bits).reshape(plan.dims, -1).astype(np.float64)


def _buckets_fn(plan: LshPlan, probing: bool):
    """Adds ``_buckets``: a bucket per table, or those that a query probes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(plan.bits)
        first = np.arange(plan.tables) << plan.bits
        for pdf in batches:
            if len(pdf) == 0:
                continue
            p = np.round(_matrix(pdf, plan.dims) @ planes(plan), 9).reshape(len(pdf), plan.tables, plan.bits)
            at = first + ((p >= 0) * weights).sum(axis=2)
            if probing and plan.probes:
                flips = weights[np.argsort(np.abs(p), axis=2, kind="stable")[:, :, :plan.probes]]
                at = np.concatenate([at[:, :, None], at[:, :, None] ^ flips], axis=2).reshape(len(pdf), -1)
            yield pdf.assign(_buckets=list(at))

    return run


def shard_of(key_cols: list[str], plan: LshPlan) -> Column:
    return F.pmod(F.xxhash64(*key_cols, "_bucket"), F.lit(plan.shards)).cast("int").alias("shard")


def bucketed(df: DataFrame, plan: LshPlan, key_cols: list[str], id_col: str, order_col: str, *, payload: tuple[str, ...] = (),
             vec_col: str | None = None, sparse: tuple[str, str] | None = None, probing: bool = False) -> DataFrame:
    """(key_cols, _bucket, _id, _ord, payload, vector, shard): a row per vector and bucket."""
    names = ["_i", "_x"] if sparse else ["_v"]
    rows = df.where(has_vector(vec_col, sparse)).select(*key_cols, vector_id(df, id_col), F.col(order_col).alias("_ord"), *payload, *_vec_cols(df, vec_col, sparse))
    schema = T.StructType([*rows.schema.fields, T.StructField("_buckets", T.ArrayType(T.LongType()))])
    rows = rows.mapInPandas(_buckets_fn(plan, probing), schema)
    return rows.select(*key_cols, F.explode("_buckets").alias("_bucket"), "_id", "_ord", *payload, *names).withColumn("shard", shard_of(key_cols, plan))


def append_index(vectors: DataFrame, path: str, plan: LshPlan, batch: str, key_cols: list[str] = ("repo_id",), id_col: str = "id",
                 order_col: str = "seq", **vec) -> None:
    """Write a batch's rows below ``path``; the same batch written again replaces its own folder only."""
    spark = vectors.sparkSession
    if (known := stored_plan(spark, path)) is None:
        spark.createDataFrame([asdict(plan)]).coalesce(1).write.mode("overwrite").parquet(f"{path}/plan")
    elif known != plan:
        raise ValueError(f"the index at {path} has {known}")
    rows = bucketed(vectors, plan, list(key_cols), id_col, order_col, **vec)
    (rows.withColumn("batch", F.lit(batch)).repartition("shard").sortWithinPartitions("shard", *key_cols, "_bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "shard").parquet(f"{path}/rows"))


def stored_plan(spark: SparkSession, path: str) -> LshPlan | None:
    got = read_if_written(spark, f"{path}/plan")
    return None if got is None else LshPlan(**got.first().asDict())


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    rows = read_if_written(spark, f"{path}/rows")
    return None if rows is None else rows.drop("batch")


def crowded(sizes: DataFrame, keys: list[str], block_rows: int, name: str) -> DataFrame:
    """The buckets of more than a block, with their number of blocks."""
    return sizes.where(F.col("_n") > block_rows).select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias(name))


GROUP = ["_cell", "qb", "hb"]


def paired_blocks(queries: DataFrame, index: DataFrame, key_cols: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows dealt to groups (``GROUP``): a cell of many small buckets, or a pair of blocks of a crowded one.

    Only buckets that a query probes are read, from the shards that hold them."""
    keys = [*key_cols, "_bucket"]
    fields = [*keys, "_id", "_ord", *[c for c in ("_i", "_x", "_v") if c in queries.columns]]
    # the buckets and their sizes are made once; short lists of them are broadcast, so the vectors move once, to their groups
    sizes = few(queries.groupBy(*keys, "shard").agg(F.count(F.lit(1)).alias("_n")))
    nq = few(crowded(sizes, keys, block_rows, "_nq"))
    index = index.join(queries.select("shard").distinct(), "shard", "left_semi").join(sizes.select(*keys), keys, "left_semi")
    nh = few(crowded(index.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, block_rows, "_nh"))
    q, h = queries.select(*fields), index.select(*fields)
    cells = max(1024, 4 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.xxhash64(*keys)

    def blocks(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        x = df.join(nq, keys, "left").join(nh, keys, "left")
        x = x.withColumn("_cell", F.when(F.col("_nq").isNull() & F.col("_nh").isNull(), F.pmod(place, F.lit(cells))).otherwise(place))
        x = x.withColumn(mine, F.pmod(F.xxhash64("_id"), F.coalesce(own, F.lit(1))).cast("int"))
        x = x.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return x.select(*[F.col(c).alias(c) for c in (*GROUP, *fields)])

    return blocks(q, "_nq", "_nh", "qb", "hb"), blocks(h, "_nh", "_nq", "hb", "qb")


class Side:
    """One side of a group: ids, orders and vectors of its rows."""

    def __init__(self, t: pa.Table, dims: int):
        self.ids, self.order, self.dims = t["_id"].to_numpy(), t["_ord"].to_numpy(), dims
        self.columns = [t[c].combine_chunks() for c in t.column_names if c in ("_i", "_x", "_v")]

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        parts = [c.take(pa.array(rows)) for c in self.columns]
        values = parts[-1].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(parts) == 1:
            return values.reshape(len(rows), -1)
        out = np.zeros((len(rows), self.dims))
        out[np.repeat(np.arange(len(rows)), pc.list_value_length(parts[0]).to_numpy(zero_copy_only=False)), parts[0].flatten().to_numpy(zero_copy_only=False)] = values
        return out


def buckets_of(q: pa.Table, h: pa.Table, keys: list[str], dims: int, rows: int) -> Iterator[tuple[Side, Side, np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each bucket on both sides: the sides, its rows there (the right ones in id order) and their scores.

    The vectors of small buckets are laid out together, ``rows`` rows at a time. A bucket of more rows has no scores yet.
    """
    left, right, code = Side(q, dims), Side(h, dims), np.zeros(len(q) + len(h), np.int64)
    for c in keys:
        known, levels = pd.factorize(np.concatenate([q[c].to_numpy(zero_copy_only=False), h[c].to_numpy(zero_copy_only=False)]))
        code = np.unique(code * (len(levels) + 1) + known, return_inverse=True)[1]
    at_q = np.argsort(code[:len(q)], kind="stable")
    at_h = np.argsort(right.ids, kind="stable")
    at_h = at_h[np.argsort(code[len(q):][at_h], kind="stable")]
    code_q, code_h = code[:len(q)][at_q], code[len(q):][at_h]
    both = np.intersect1d(code_q, code_h)
    q0, q1, h0, h1 = (np.searchsorted(x, both, side) for x in (code_q, code_h) for side in ("left", "right"))
    lo = 0
    while lo < len(both):
        hi = lo + 1
        while hi < len(both) and q1[hi] - q0[lo] <= rows and h1[hi] - h0[lo] <= rows:
            hi += 1
        if max(q1[lo] - q0[lo], h1[lo] - h0[lo]) > rows:
            yield left, right, at_q[q0[lo]:q1[lo]], at_h[h0[lo]:h1[lo]], None
            lo = hi
            continue
        mq, mh = left.matrix(at_q[q0[lo]:q1[hi - 1]]), right.matrix(at_h[h0[lo]:h1[hi - 1]])
        for i in range(lo, hi):
            yield (left, right, at_q[q0[i]:q1[i]], at_h[h0[i]:h1[i]], mq[q0[i] - q0[lo]:q1[i] - q0[lo]] @ mh[h0[i] - h0[lo]:h1[i] - h0[lo]].T)
        lo = hi


def search(queries: DataFrame, index: DataFrame, *, key_cols: list[str] = ("repo_id",), k: int = DEFAULT_LIMIT, threshold: float = DEFAULT_THRESHOLD,
           asof: bool = False, exclude_same_id: bool = True, block_rows: int = 2048, dims: int = DIMS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key_cols, query_id, match_id, score, rank): the k best matches at or above ``threshold`` among the rows that share a bucket.

    ``queries`` are rows of ``bucketed(..., probing=True)``, ``index`` rows of
    ``read_index`` or ``bucketed``. ``asof``: a match has a smaller order.
    """
    key_cols = list(key_cols)
    keys = [*key_cols, "_bucket"]
    schema = T.StructType([queries.schema[c] for c in key_cols] + [T.StructField("q_id", queries.schema["_id"].dataType),
                                                                   T.StructField("h_id", index.schema["_id"].dataType), T.StructField("score", T.DoubleType())])

    def score(q: pa.Table, h: pa.Table) -> pa.Table:
        at_q, at_h, scores = [], [], []
        if len(q) and len(h):
            for left, right, i, j, s in buckets_of(q, h, keys, dims, block_rows):
                told = left.ids[i], right.ids[j], left.order[i] if asof else None, right.order[j] if asof else None, k, threshold, exclude_same_id
                if s is None:
                    rows, cols, found = best_in_group(lambda x, i=i: left.matrix(i[x]), lambda x, j=j: right.matrix(j[x]), *told, block_rows)
                else:
                    rows, cols = best_in_block(s, *told)
                    found = s[rows, cols]
                if len(rows):
                    at_q.append(i[rows])
                    at_h.append(j[cols])
                    scores.append(found)
        at_q, at_h, scores = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((at_q, np.int64), (at_h, np.int64), (scores, np.float64)))
        out, other = q.take(pa.array(at_q)), h.take(pa.array(at_h))
        return pa.table({**{c: out[c] for c in key_cols}, "q_id": out["_id"], "h_id": other["_id"], "score": scores})

    qx, hx = paired_blocks(queries, index, key_cols, group_rows)
    scored = qx.groupBy(*GROUP).cogroup(hx.groupBy(*GROUP)).applyInArrow(score, schema)
    # One exchange by query serves both the dedupe of pairs met in several buckets and the ranking.
    best = scored.repartition(*key_cols, "q_id").groupBy(*key_cols, "q_id", "h_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*key_cols, "q_id").orderBy(F.desc("score"), "h_id")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .withColumnsRenamed({"q_id": "query_id", "h_id": "match_id"}))
