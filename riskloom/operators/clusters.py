"""Duplicate-logic clusters.

Exact copies group by content hash. Near copies are connected components of
the "cosine >= t within a repository" graph, found without materialising the
pair list:

1. exact copies collapse to one representative first (a clique of identical
   texts becomes one node);
2. representatives are cut into groups per repository (``vectors``), and every
   pair of groups is one task: exact, so no link is missed. The pair is scored
   in blocks by matrix products, and each block emits a
   star per local component (member -> smallest id; at most |Q| + |H| - 1
   edges), which connects what its links connect and already carries local
   minima. The work is quadratic in a repository's different texts: buckets of
   random planes prune little, as hashed counts of natural text all point the
   same way, and would send a row once per table and block;
3. components come from min-label propagation with pointer jumping, one join
   round per iteration, lineage cut with ``checkpoint()`` into the session's
   checkpoint folder; the loop stops when no label changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..session import ensure_checkpoint_dir, materialize
from .ann import Side
from .vectors import DIMS, GROUP_ROWS, _blocked, _vec_cols, has_vector, vector_id


def exact_duplicates(df: DataFrame, *, keys=("repo_id",), id_col="seq", text_col="code_body") -> DataFrame:
    """Groups of identical (stripped) texts: (keys, code_hash, n_copies, first_id)."""
    keys = list(keys)
    h = df.select(*keys, id_col, S.code_hash(text_col).alias("code_hash"))
    return (h.groupBy(*keys, "code_hash")
             .agg(F.count(F.lit(1)).alias("n_copies"), F.min(id_col).alias("first_id"))
             .where(F.col("n_copies") > 1))


def _stars(adjacent: np.ndarray, q_ids: np.ndarray, h_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest id of its component) of the graph between two lists of ids, by whole-matrix label passes."""
    rows, cols = np.nonzero(adjacent)
    if not len(rows):
        return q_ids[:0], q_ids[:0]
    ids, at = np.unique(np.concatenate([q_ids, h_ids]), return_inverse=True)
    qi, hi = at[:len(q_ids)][rows], at[len(q_ids):][cols]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, qi, label[hi])
        np.minimum.at(new, hi, new[qi])
        new = new[new]
        if (new == label).all():
            moved = label != np.arange(len(ids))
            return ids[moved], ids[label[moved]]
        label = new


def similarity_forest(vectors: DataFrame, *, keys=("repo_id",), id_col="seq", vec_col="vector",
                      threshold: float = 0.9, block_rows: int = 2048, group_rows: int = GROUP_ROWS,
                      sparse: tuple[str, str] | None = None, dims: int = DIMS) -> DataFrame:
    """Edges (keys, a, b) of the cosine >= threshold graph within each key, reduced per pair of
    blocks to stars on local component minima. Exact: every pair of rows of a key is scored once."""
    keys = list(keys)
    vec = {"sparse": sparse, "vec_col": None if sparse else vec_col}
    rows = vectors.where(has_vector(**vec)).select(*keys, vector_id(vectors, id_col), F.lit(0).alias("_ord"), *_vec_cols(vectors, **vec))
    kind = rows.schema["_id"].dataType
    schema = T.StructType([vectors.schema[c] for c in keys] + [T.StructField("a", kind), T.StructField("b", kind)])

    def stars(key, q: pa.Table, h: pa.Table) -> pa.Table:
        a, b = [], []
        if len(q) and len(h):
            left, right = Side(q, dims), Side(h, dims)
            at_q, at_h = np.argsort(left.ids, kind="stable"), np.argsort(right.ids, kind="stable")
            same = key[-2].as_py() == key[-1].as_py()   # a group with itself: each pair of its blocks once
            for x in range(0, len(at_q), block_rows):
                i = at_q[x:x + block_rows]
                m = left.matrix(i)
                for y in range(x if same else 0, len(at_h), block_rows):
                    j = at_h[y:y + block_rows]
                    member, least = _stars(m @ right.matrix(j).T >= threshold, left.ids[i], right.ids[j])
                    a.append(member)
                    b.append(least)
        n, ids = sum(map(len, a)), q["_id"].type if len(q) else h["_id"].type
        return pa.table({**{c: pa.array([v.as_py()] * n, v.type) for c, v in zip(keys, key)},
                         **{c: pa.array(np.concatenate(x) if x else [], ids) for c, x in (("a", a), ("b", b))}})

    rows = _blocked(rows, keys, "_id", block_rows, "_at", group_rows)
    fields = [*keys, "_id", "_ord", *[c for c in ("_i", "_x", "_v") if c in rows.columns]]

    def side(mine: str, other: str, first, last) -> DataFrame:
        x = rows.withColumn(other, F.explode(F.sequence(first, last))).withColumn(mine, F.col("_at"))
        return x.select(*[F.col(c).alias(c) for c in (*fields, "qb", "hb")])

    group = [*keys, "qb", "hb"]
    qx, hx = side("qb", "hb", F.col("_at"), F.col("_at_n") - 1), side("hb", "qb", F.lit(0), F.col("_at"))
    return qx.groupBy(*group).cogroup(hx.groupBy(*group)).applyInArrow(stars, schema).distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, *, keys=()) -> DataFrame:
    """(keys, node, component) with component = smallest node id of the component.

    Min-label propagation with pointer jumping until no label changes; each round is a few joins and
    aggregates, checkpointed so the plan stays one round deep. A component
    holding a third of all nodes is a hot label key in the jump join; AQE's
    skew-join splitting handles that side.
    """
    keys = list(keys)
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    both = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")),
                             F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    und = edges.select(*keys, both.alias("_e")).select(*keys, "_e.a", "_e.b").distinct()
    und = und.checkpoint()
    if nodes is None:
        nodes = und.select(*keys, F.col("a").alias("node")).distinct()
    labels = nodes.select(*keys, "node", F.col("node").alias("label")).checkpoint()
    while True:
        # neighbour minimum
        nb = (und.join(labels.withColumnRenamed("node", "b"), [*keys, "b"])
                 .groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("nl")))
        step = (labels.join(nb, [*keys, "node"], "left")
                      .select(*keys, "node", F.least("label", F.coalesce("nl", "label")).alias("label")))
        # pointer jumping: label <- label of the label
        jump = step.select(*keys, F.col("node").alias("label"), F.col("label").alias("ll"))
        new = (step.join(jump, [*keys, "label"], "left")
                   .select(*keys, "node", F.least("label", F.coalesce("ll", "label")).alias("label"))
                   .checkpoint())
        changed = (new.join(labels.withColumnRenamed("label", "old"), [*keys, "node"])
                      .where(F.col("label") != F.col("old")).limit(1).count())
        labels = new
        if changed == 0:
            return labels.withColumnRenamed("label", "component")


def duplicate_clusters(df: DataFrame, vectors: DataFrame, *, keys=("repo_id",), id_col="seq",
                       text_col="code_body", threshold: float = 0.9, block_rows: int = 2048,
                       sparse: tuple[str, str] | None = ("indices", "values")) -> DataFrame:
    """(keys, id, cluster_id, cluster_size) for functions in clusters of >= 2
    (exact copies and near copies with cosine >= threshold)."""
    keys = list(keys)
    # (id, content hash) is read three times below; hash the texts once
    h = materialize(df.select(*keys, F.col(id_col).alias("_id"), S.code_hash(text_col).alias("_h")))
    rep = h.groupBy(*keys, "_h").agg(F.min("_id").alias("_rep"))
    members = h.join(rep, [*keys, "_h"])
    # read for the sizes and for both sides of the groups
    reps = materialize(vectors.join(rep.select(*keys, F.col("_rep").alias(id_col)), [*keys, id_col], "left_semi"))
    forest = similarity_forest(reps, keys=keys, id_col=id_col, threshold=threshold, block_rows=block_rows,
                               sparse=sparse)
    rep_nodes = rep.select(*keys, F.col("_rep").alias("node"))
    comp = connected_components(forest, rep_nodes, keys=keys)
    out = (members.join(comp.withColumnRenamed("node", "_rep"), [*keys, "_rep"])
                  .select(*keys, F.col("_id").alias(id_col), "component"))
    sizes = out.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("cluster_size"),
                                                F.min(id_col).alias("cluster_id"))
    return (out.join(sizes, [*keys, "component"]).where(F.col("cluster_size") > 1)
               .select(*keys, id_col, "cluster_id", "cluster_size"))
