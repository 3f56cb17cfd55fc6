"""Embedding and vector-similarity operators.

Scale notes
-----------
* ``cosine_topk`` never forms the row-pair product of a repository as rows.
  Each side is cut into groups of rows per key (repository): eight, or as many
  as keep a group at ``group_rows``. Every (query group, history group) pair of
  a key is one cogroup, so a vector is sent once per group of the other side. A
  Python worker scores a pair in blocks of ``block_rows`` by ``block_rows``,
  each a matrix product, and keeps the top-k per query row by (score desc, id
  asc) over all of them — at most k per row, exact under ties. A repository
  holding a third of all vectors becomes many bounded group pairs spread
  over all executors instead of one giant task.
* Sparse vectors are sent packed (``packed``), about a quarter of the bytes of
  their arrays even after the shuffle's compression, and in fewer and larger
  groups: they are packed once, into the checkpoint folder, and unpacked a block
  at a time. Up to ``GROUPS_PACKED`` x ``GROUP_ROWS_PACKED`` rows of a key, a
  vector is sent ``GROUPS_PACKED`` + 1 times in an as-of search, both sides together.
* As-of searches (a function sees only earlier ones) block by order range
  and never form the block pairs whose history range lies after the query
  range — about half of them.
* Group counts come from a partial (map-side) ``count`` per key, computed
  once; the table has a row per key or group and is broadcast while it is
  short, so the vectors are not shuffled by key for it.
* The approximate search over a stored index is in ``ann``; it scores its
  buckets with the same exact block scorer.
* ``embed_hashed_sparse`` works row by row: the JVM cuts texts into lower-case
  tokens, a Python worker hashes each different token of a batch once and counts
  buckets in one array; texts are not shuffled. Only ids that come in several
  rows are summed by a shuffle of their counts. The dense form collects at most
  ``dims`` entries per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .packed import counted, pack, unpack

# Fixed values of the reference's vector model: 768 dimensions, cosine.
DIMS = 768
DEFAULT_THRESHOLD = 0.80
DEFAULT_LIMIT = 10
# Rows of a group of the exact search, and of the tables of sizes that are still broadcast.
GROUP_ROWS = 32768
GROUPS = 8
# The same for packed vectors: a group of them takes less memory than a smaller one of arrays.
GROUP_ROWS_PACKED = 131072
GROUPS_PACKED = 6
# Blocks of rows for which a block of packed columns is unpacked once.
WIDE = 4
FEW = 100_000


def few(sizes: DataFrame) -> DataFrame:
    """A table of sizes, computed once; it is broadcast while it has few rows."""
    sizes = materialize(sizes)
    return F.broadcast(sizes) if sizes.limit(FEW + 1).count() <= FEW else sizes


# ---------------------------------------------------------------- E3 -------
def l2_normalize(vec: Column | str) -> Column:
    """Unit vector of an array column; the zero vector gives null."""
    v = F.col(vec) if isinstance(vec, str) else vec
    # the norm is computed once, in aggregate's finish step (not per element)
    return F.aggregate(
        v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda acc: F.when(acc > 0, F.transform(v, lambda x: x.cast("double") / F.sqrt(acc))))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two equal-length arrays, summed in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


# ---------------------------------------------------------------- E2 -------
def mean_pool_long(df: DataFrame, group_cols: list[str], vec_col: str) -> DataFrame:
    """Element-wise mean of the vectors of each group, long form (group, dim, value).

    ``posexplode`` then a partial ``avg`` per (group, dim): the shuffle carries
    one partial sum per group and dimension per map task, so a hot group costs
    no more than any other.
    """
    return (df.select(*group_cols, F.posexplode(vec_col).alias("dim", "x"))
              .groupBy(*group_cols, "dim")
              .agg(F.avg(F.col("x").cast("double")).alias("value")))


def mean_pool(df: DataFrame, group_cols: list[str], vec_col: str,
              out_col: str = "vector") -> DataFrame:
    """Masked-mean pooling re-aimed as a vector aggregate: one mean vector per group."""
    long = mean_pool_long(df, group_cols, vec_col)
    return (long.groupBy(*group_cols)
                .agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("_e"))
                .select(*group_cols, F.col("_e.value").alias(out_col)))


# ---------------------------------------------------------------- E1 -------
# Tokens are runs of letters, digits and underscores of any script, lower-cased; bucket = first 8 hex digits of the
# token's md5, modulo the dimension count (same rule in the SQL twin).
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def token_bucket(token: Column, dims: int = DIMS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dims))


# Rows whose buckets are counted at a time.
COUNT_ROWS = 1024


def _hashed(tokens: pa.Array, dims: int) -> np.ndarray:
    """The buckets of some tokens (the rule of ``token_bucket``)."""
    digests = b"".join([hashlib.md5(t).digest() for t in tokens.cast(pa.binary()).to_pylist()])
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64) % dims


def _bucket_counts(rows: DataFrame, tokens: str, dims: int) -> DataFrame:
    """Rows with their list of tokens replaced by ``_e``: (ascending buckets, their counts). Rows without a token are left out.

    Each different token of a batch is hashed once, and the counts of ``COUNT_ROWS`` rows are one array.
    """
    kept = [f for f in rows.schema.fields if f.name != tokens]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(tokens))
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            buckets, codes = _hashed(coded.dictionary, dims), coded.indices.to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(length)])
            for a in range(0, len(length), COUNT_ROWS):
                n = length[a:a + COUNT_ROWS]
                counts = np.bincount(np.repeat(np.arange(len(n)) * dims, n) + buckets[codes[first[a]:first[a + len(n)]]], minlength=len(n) * dims)
                at, there = np.flatnonzero(counts), np.flatnonzero(n)
                ends = np.concatenate([[0], np.searchsorted(at, (there + 1) * dims)]).astype(np.int32)
                entries = pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array((at % dims).astype(np.int32))),
                                                      pa.ListArray.from_arrays(ends, pa.array(counts[at].astype(np.float64)))], ["bucket", "n"])
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(pa.array(a + there)) for c in names), entries], [*names, "_e"])

    entry = T.StructType([T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("_e", entry)]))


def embed_hashed_sparse(df: DataFrame, id_cols: list[str], text_col: str,
                        dims: int = DIMS, unique: bool = False) -> DataFrame:
    """Hashed term-count embedding as a sparse unit vector: (ids, indices, values).

    Each row is tokenised and counted by itself. indices are ascending
    bucket numbers (at most ``dims`` per document); values are
    count / sqrt(sum(count^2)). Whole texts are tokenised (no prefix cut).
    Rows of the same ids are one document: their counts are summed. The ids are
    counted first for that, unless they are known to be ``unique``.
    """
    id_cols = list(id_cols)
    tokens = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_PATTERN), 0), F.lower)
    ent = _bucket_counts(df.select(*id_cols, tokens.alias("_tokens")), "_tokens", dims)
    if not unique:
        again = materialize(df.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*id_cols))
        if not again.isEmpty():
            again = few(again.withColumnsRenamed({c: f"_again_{c}" for c in id_cols}))
            same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_again_{c}")) for c in id_cols])
            counts = (ent.join(again, same, "left_semi").select(*id_cols, F.explode(F.arrays_zip("_e.bucket", "_e.n")).alias("_z"))
                         .groupBy(*id_cols, F.col("_z.bucket").alias("bucket")).agg(F.sum("_z.n").alias("n")))
            summed = (counts.groupBy(*id_cols).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("_e"))
                            .select(*id_cols, F.struct(F.col("_e.bucket").alias("bucket"), F.col("_e.n").alias("n")).alias("_e")))
            ent = ent.join(again, same, "left_anti").unionByName(summed)
    # the norm is computed once, in aggregate's finish step (not per element)
    unit = F.aggregate("_e.n", F.lit(0.0), lambda acc, x: acc + x * x, lambda acc: F.transform(F.col("_e.n"), lambda x: x / F.sqrt(acc)))
    return ent.select(*id_cols, F.col("_e.bucket").alias("indices"), unit.alias("values"))


def embed_hashed_long(df: DataFrame, id_cols: list[str], text_col: str,
                      dims: int = DIMS) -> DataFrame:
    """The sparse embedding in long form (ids, bucket, weight)."""
    sp = embed_hashed_sparse(df, id_cols, text_col, dims)
    return (sp.select(*id_cols, F.explode(F.arrays_zip("indices", "values")).alias("_z"))
              .select(*id_cols, F.col("_z.indices").alias("bucket"), F.col("_z.values").alias("weight")))


def densify(long: DataFrame, id_cols: list[str], dims: int = DIMS,
            out_col: str = "vector", dtype: str = "float") -> DataFrame:
    """Long (ids, bucket, weight) -> dense array of ``dims`` entries per id."""
    m = F.map_from_entries(F.collect_list(F.struct("bucket", "weight")))
    return (long.groupBy(*id_cols).agg(m.alias("_m"))
                .select(*id_cols, F.transform(
                    F.sequence(F.lit(0), F.lit(dims - 1)),
                    lambda i: F.coalesce(F.element_at("_m", i.cast("bigint")), F.lit(0.0)).cast(dtype),
                ).alias(out_col)))


def embed_hashed(df: DataFrame, id_cols: list[str], text_col: str,
                 dims: int = DIMS, out_col: str = "vector", dtype: str = "float") -> DataFrame:
    """Default text -> unit vector function, dense form (for consumers that
    need a fixed-length array; the similarity operators take the sparse form)."""
    return densify(embed_hashed_long(df, id_cols, text_col, dims), id_cols, dims, out_col, dtype)


# ---------------------------------------------------------------- E5 -------
def embed_dedup(df: DataFrame, key_cols: list[str], hash_col: str, text_col: str,
                known: DataFrame | None = None, dims: int = DIMS,
                embed=None) -> DataFrame:
    """Embed each distinct (key, code hash) once and join the vectors back.

    ``known`` (key_cols + hash_col + the vector columns) holds vectors computed
    earlier; only hashes absent from it are embedded (left anti join), which
    is the set-based form of the reference's per-function cache lookup.
    ``embed(df, ids, text_col)`` defaults to the sparse hashed embedding.
    """
    embed = embed or (lambda d, ids, col: embed_hashed_sparse(d, ids, col, dims, unique=True))
    ids = [*key_cols, hash_col]
    distinct = df.select(*ids, text_col).dropDuplicates(ids)
    if known is not None:
        distinct = distinct.join(known.select(*ids), ids, "left_anti")
    fresh = embed(distinct, ids, text_col)      # texts without a token get no vector
    if known is not None:
        fresh = fresh.unionByName(known.select(*fresh.columns))
    return df.join(fresh, ids, "left")


# ---------------------------------------------------------------- V1 -------
def _matrix(pdf: pd.DataFrame, dims: int | None) -> np.ndarray:
    """Rows of a block as a float64 matrix, from a dense ``_v`` column, packed ``_p`` or
    sparse ``_i``/``_x`` (indices/values) columns scattered into ``dims`` columns."""
    if "_p" in pdf.columns:
        return unpack(pdf["_p"].tolist(), dims)
    if "_v" in pdf.columns:
        return np.stack(pdf["_v"].to_numpy()).astype(np.float64, copy=False)
    idx = pdf["_i"].to_numpy()
    val = pdf["_x"].to_numpy()
    lens = np.fromiter((len(a) for a in idx), dtype=np.int64, count=len(idx))
    m = np.zeros((len(idx), dims), dtype=np.float64)
    if lens.sum():
        rows = np.repeat(np.arange(len(idx)), lens)
        m[rows, np.concatenate(idx).astype(np.int64)] = np.concatenate(val).astype(np.float64)
    return m


def has_vector(vec_col: str | None, sparse: tuple[str, str] | None) -> Column:
    """Whether a row has a vector to search with: a function without any token has none."""
    return F.coalesce(F.size(sparse[0]) > 0, F.lit(False)) if sparse else F.col(vec_col).isNotNull()


def vector_id(df: DataFrame, id_col: str) -> Column:
    """Ids keep their type if they are strings, and are longs otherwise."""
    c = F.col(id_col)
    return (c if isinstance(df.schema[id_col].dataType, T.StringType) else c.cast("bigint")).alias("_id")


def _vec_cols(df: DataFrame, vec_col: str | None, sparse: tuple[str, str] | None):
    if sparse:
        return [F.col(sparse[0]).alias("_i"), F.col(sparse[1]).alias("_x")]
    return [F.col(vec_col).alias("_v")]


def packed(rows: DataFrame, dims: int, block_rows: int = 2048) -> DataFrame:
    """Sparse rows with their vectors packed (``_p``), ``block_rows`` of them as a matrix at a time; other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, block_rows) for a in range(0, whole.num_rows, block_rows)):
                vectors = pack(_matrix(batch.select(["_i", "_x"]).to_pandas(), dims))
                kept = [c for c in batch.schema.names if c not in ("_i", "_x")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(vectors, pa.binary())], [*kept, "_p"])

    kept = rows.drop("_i", "_x")
    return rows.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("_p", T.BinaryType())]))


def best_in_block(s: np.ndarray, q_ids: np.ndarray, h_ids: np.ndarray, q_ord: np.ndarray | None, h_ord: np.ndarray | None,
                  k: int | None, threshold: float | np.ndarray, exclude_same_id: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best scores at or above ``threshold`` (one, or one per row); columns must be in id order.

    Exactly the k best by (score desc, id asc): everything above the k-th score,
    then ties at the cut in id order up to k. Every global top-k member is in its
    block's top-k, so merging blocks is exact, and a block never gives more than
    k rows per query row.
    """
    keep = s >= (threshold[:, None] if isinstance(threshold, np.ndarray) else threshold)
    if exclude_same_id:
        keep &= q_ids[:, None] != h_ids[None, :]
    if q_ord is not None:
        keep &= h_ord[None, :] < q_ord[:, None]
    if k is not None and k < s.shape[1]:
        crowded = np.nonzero(keep.sum(axis=1) > k)[0]
        for rows in (crowded[i:i + 256] for i in range(0, len(crowded), 256)):
            x = np.where(keep[rows], s[rows], -np.inf)
            kth = np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]
            above = x > kth[:, None]
            tie = x == kth[:, None]
            need = k - above.sum(axis=1)
            keep[rows] = above | (tie & (np.cumsum(tie, axis=1) <= need[:, None]))
    return np.nonzero(keep)


class Counts:
    """Vectors of counts: their dot products are whole numbers, exact in single precision below 2^24."""

    def __init__(self, rows: list[bytes], dims: int):
        self.matrix = unpack(rows, dims, unit=False)
        self.squares = np.einsum("ij,ij->i", self.matrix, self.matrix, dtype=np.float64)
        self.norm = np.sqrt(np.where(self.squares > 0, self.squares, 1))

    def dots(self, other: Counts, out: np.ndarray) -> np.ndarray:
        if self.squares.max() * other.squares.max() < 2 ** 48:    # no dot product is over the root of it
            return np.matmul(self.matrix, other.matrix.T, out=out[:len(self.norm), :len(other.norm)] if len(other.norm) == out.shape[1] else None)
        return self.matrix.astype(np.float64) @ other.matrix.T.astype(np.float64)


# Candidates per row of a block from which its scores are all computed.
CROWDED = 256


def _nonzero(flags: np.ndarray) -> np.ndarray:
    """Flat positions of the true values, of which there are few: eight flags are looked at together."""
    flat = flags.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    at = np.flatnonzero(flat.reshape(-1, 8)[words])
    return words[at // 8] * 8 + at % 8


def _hits(left: np.ndarray | Counts, right: np.ndarray | Counts, room: np.ndarray, q_ids: np.ndarray, h_ids: np.ndarray, q_ord: np.ndarray | None,
          h_ord: np.ndarray | None, k: int | None, least: np.ndarray, exclude_same_id: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of a block's scores that reach ``least``, the k best of a row among them.

    Counts are compared in single precision with a margin; the scores of what is left are the whole dot products
    divided by the root of the squares' product, in double precision.
    """
    told = q_ids, h_ids, q_ord, h_ord, k, least, exclude_same_id
    if isinstance(left, Counts):
        d = left.dots(right, room[0])
        bar = least * left.norm
        bar = (bar - 1e-6 * np.abs(bar)).astype(np.float32)
        near = _nonzero(np.multiply(d, (1 / right.norm).astype(np.float32), out=room[1][:d.shape[0]] if d.shape[1] == room.shape[2] and d.dtype == room.dtype else None)
                        >= bar[:, None])
        if k is None or len(near) <= CROWDED * len(d):
            x, y = np.divmod(near, d.shape[1])
            v = d[x, y] / np.sqrt(np.where((left.squares[x] > 0) & (right.squares[y] > 0), left.squares[x] * right.squares[y], 1))
            keep = v >= least[x]
            if exclude_same_id:
                keep &= q_ids[x] != h_ids[y]
            if q_ord is not None:
                keep &= h_ord[y] < q_ord[x]
            return x[keep], y[keep], v[keep]
        both = np.multiply.outer(left.squares, right.squares)
        s = d / np.sqrt(np.where(both > 0, both, 1))
    else:
        s = left @ right.T
    x, y = best_in_block(s, *told)
    return x, y, s[x, y]


def best_in_group(matrix_q: Callable[[np.ndarray], np.ndarray | Counts], matrix_h: Callable[[np.ndarray], np.ndarray | Counts], q_ids: np.ndarray, h_ids: np.ndarray,
                  q_ord: np.ndarray | None, h_ord: np.ndarray | None, k: int | None, threshold: float, exclude_same_id: bool,
                  block_rows: int, wide: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's k best over a whole group, scored in blocks of ``block_rows`` rows a side.

    ``matrix_q`` and ``matrix_h`` give the vectors of the rows at some positions. Blocks run over the columns in id
    order; a row that has k matches takes only scores above the last of them (a later column loses a tie). Blocks of
    columns that all come after the rows (as-of) are not scored. The vectors of a block of columns are made once for
    ``wide`` blocks of rows.
    """
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    found = [empty]
    at_h = np.argsort(h_ids, kind="stable")
    at_q = np.arange(len(q_ids)) if q_ord is None else np.argsort(q_ord, kind="stable")
    room = np.empty((2, min(block_rows, len(at_q)), min(block_rows, len(at_h))), np.float32) if wide > 1 else np.empty((2, 0, 0), np.float32)
    for b in range(0, len(at_q), wide * block_rows):
        blocks = [at_q[a:a + block_rows] for a in range(b, min(b + wide * block_rows, len(at_q)), block_rows)]
        lefts, leasts, bests = [matrix_q(i) for i in blocks], [np.full(len(i), threshold, np.float64) for i in blocks], [empty] * len(blocks)
        for a in range(0, len(at_h), block_rows):
            j = at_h[a:a + block_rows]
            reached = [n for n, i in enumerate(blocks) if q_ord is None or h_ord[j].min() < q_ord[i].max()]
            right = matrix_h(j) if reached else None
            for n in reached:
                i, least, (r, c, v) = blocks[n], leasts[n], bests[n]
                x, y, s = _hits(lefts[n], right, room, q_ids[i], h_ids[j], None if q_ord is None else q_ord[i], None if q_ord is None else h_ord[j], k, least, exclude_same_id)
                if not len(x):
                    continue
                r, c, v = np.concatenate([r, x]), np.concatenate([c, y + a]), np.concatenate([v, s])
                if k is not None:
                    order = np.lexsort((c, -v, r))
                    r, c, v = r[order], c[order], v[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c, v, place = (z[place < k] for z in (r, c, v, place))
                    least[r[place == k - 1]] = np.nextafter(v[place == k - 1], np.inf)
                bests[n] = r, c, v
        found += [(i[r], at_h[c], v) for i, (r, c, v) in zip(blocks, bests)]
    return tuple(np.concatenate(z) for z in zip(*found))


def _block_topk_fn(key_names: list[str], k: int, threshold: float, asof: bool,
                   exclude_same_id: bool, dims: int | None = None, block_rows: int = 2048):
    """The scorer of a pair of groups, run in a Python worker."""

    def fn(key, q: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        qid, hid = q["_id"].to_numpy(), h["_id"].to_numpy()
        at_q, at_h, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(q) and len(h):
            same = np.unique(np.concatenate([qid, hid]), return_inverse=True)[1]   # ids of any type as their ranks
            vectors = [lambda i, x=x: _matrix(x.iloc[i], dims) for x in (q, h)]
            whole = [x["_p"].tolist() for x in (q, h)] if "_p" in q.columns else []
            if whole and all(map(counted, whole)):
                vectors = [lambda i, x=x: Counts([x[r] for r in i], dims) for x in whole]
            at_q, at_h, scores = best_in_group(*vectors, same[:len(q)], same[len(q):], q["_ord"].to_numpy() if asof else None, h["_ord"].to_numpy() if asof else None,
                                               k, threshold, exclude_same_id, block_rows, WIDE if whole else 1)
        out = pd.DataFrame({"q_id": qid[at_q], "h_id": hid[at_h], "score": scores})
        for i, name in enumerate(key_names):
            out.insert(i, name, key[i] if len(out) else pd.Series([], dtype="object"))
        return out

    return fn


def _groups(n: Column, block_rows: int, group_rows: int, groups: int = GROUPS) -> Column:
    """Into how many groups ``n`` rows are cut: blocks of ``block_rows``, but few of them while a group has ``group_rows`` at most."""
    return F.greatest(F.lit(1), F.least(F.ceil(n / block_rows), F.greatest(F.lit(groups), F.ceil(n / group_rows)))).cast("int")


def _blocked(df: DataFrame, key_cols: list[str], id_col: str, block_rows: int,
             blk: str, group_rows: int = 0, groups: int = GROUPS) -> DataFrame:
    """Rows dealt to blocks by a hash of the id; with ``group_rows`` to groups."""
    n = F.col("_n")
    sizes = (df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n"))
               .select(*key_cols, (_groups(n, block_rows, group_rows, groups) if group_rows else F.greatest(F.lit(1), F.ceil(n / block_rows)).cast("int")).alias(f"{blk}_n")))
    return (df.join(few(sizes), key_cols)
              .withColumn(blk, F.pmod(F.xxhash64(id_col), F.col(f"{blk}_n")).cast("int")))


def _hash_pairs(q: DataFrame, h: DataFrame, key_cols: list[str], block_rows: int, group_rows: int, vnames: list[str], groups: int = GROUPS):
    """Hash groups: every query group meets every history group of its key."""
    q = _blocked(q, key_cols, "_id", block_rows, "qb", group_rows, groups)
    h = _blocked(h, key_cols, "_id", block_rows, "hb", group_rows, groups)
    hn = few(h.select(*key_cols, "hb_n").distinct())
    qn = few(q.select(*key_cols, "qb_n").distinct())
    qx = (q.join(hn, key_cols)
           .withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("hb_n") - 1)))
           .select(*key_cols, "qb", "hb", "_id", "_ord", *vnames))
    hx = (h.join(qn, key_cols)
           .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qb_n") - 1)))
           .select(*key_cols, "qb", "hb", "_id", "_ord", *vnames))
    return qx, hx, [*key_cols, "qb", "hb"]


def _range_pairs(q: DataFrame, h: DataFrame, key_cols: list[str], block_rows: int, group_rows: int, vnames: list[str], groups: int = GROUPS):
    """As-of groups: cut each key's order range into equal-width ranges (from
    the history's min/max), split crowded ranges by hash, and pair
    a query range only with history ranges at or before it. A history range
    after the query range holds only later rows, which the as-of rule rejects,
    so about half of the pairs are never formed."""
    o = F.col("_ord").cast("double")
    nr = _groups(F.col("_n"), block_rows, group_rows, groups)
    st = few(h.groupBy(*key_cols).agg(F.min(o).alias("_mn"), F.max(o).alias("_mx"), F.count(F.lit(1)).alias("_n"))
              .select(*key_cols, "_mn", nr.alias("_nr"), ((F.col("_mx") - F.col("_mn") + 1) / nr).alias("_w"),
                      F.greatest(F.lit(block_rows), F.ceil(1.25 * F.col("_n") / nr)).alias("_most")))

    def ranged(df):
        rb = F.least(F.col("_nr") - 1, F.greatest(F.lit(0), F.floor((o - F.col("_mn")) / F.col("_w"))))
        return df.join(st, key_cols).withColumn("rb", rb.cast("int")).drop("_mn", "_nr", "_w")

    def subs(df, name):
        return few(df.groupBy(*key_cols, "rb").agg(F.count(F.lit(1)).alias("_c"), F.first("_most").alias("_most"))
                     .select(*key_cols, "rb", F.greatest(F.lit(1), F.ceil(F.col("_c") / F.col("_most"))).cast("int").alias(name)))

    q2, h2 = ranged(q), ranged(h)
    qs, hs = subs(q2, "_qsub"), subs(h2, "_hsub")
    q3 = q2.join(qs, [*key_cols, "rb"]).withColumn("sb", F.pmod(F.xxhash64("_id"), F.col("_qsub")).cast("int"))
    h3 = h2.join(hs, [*key_cols, "rb"]).withColumn("sb", F.pmod(F.xxhash64("_id"), F.col("_hsub")).cast("int"))
    hs2 = hs.select(*key_cols, F.col("rb").alias("hrb"), F.col("_hsub").alias("_n_h"))
    qs2 = qs.select(*key_cols, F.col("rb").alias("qrb"), F.col("_qsub").alias("_n_q"))
    qx = (q3.join(hs2, key_cols).where(F.col("hrb") <= F.col("rb"))
            .withColumn("hsb", F.explode(F.sequence(F.lit(0), F.col("_n_h") - 1)))
            .select(*key_cols, F.col("rb").alias("qrb"), F.col("sb").alias("qsb"), "hrb", "hsb", "_id", "_ord", *vnames))
    hx = (h3.join(qs2, key_cols).where(F.col("qrb") >= F.col("rb"))
            .withColumn("qsb", F.explode(F.sequence(F.lit(0), F.col("_n_q") - 1)))
            .select(*key_cols, "qrb", "qsb", F.col("rb").alias("hrb"), F.col("sb").alias("hsb"), "_id", "_ord", *vnames))
    return qx, hx, [*key_cols, "qrb", "qsb", "hrb", "hsb"]


def cosine_topk(queries: DataFrame, history: DataFrame | None = None, *,
                key_cols: list[str] = ("repo_id",), id_col: str = "seq",
                vec_col: str = "vector", threshold: float = DEFAULT_THRESHOLD,
                k: int = DEFAULT_LIMIT, asof_col: str | None = None,
                exclude_same_id: bool = True, block_rows: int = 2048,
                sparse: tuple[str, str] | None = None, dims: int = DIMS, group_rows: int | None = None) -> DataFrame:
    """Exact filtered cosine top-k of every query row among history rows of the same key.

    Vectors must be unit length (cosine = dot product). Returns
    (key_cols..., query_id, match_id, score, rank) with score >= threshold,
    rank 1..k by score desc then match id (``k=None``: every pair at or above
    the threshold, without rank). ``asof_col``: a match must have a
    smaller value than the query (a live search sees only earlier vectors).
    ``sparse=(indices_col, values_col)`` reads sparse vectors of ``dims``
    dimensions instead of the dense ``vec_col``. Rows without a vector match nothing.
    """
    key_cols = list(key_cols)
    history = queries if history is None else history
    ordc = asof_col or id_col
    group_rows = group_rows or (GROUP_ROWS_PACKED if sparse else GROUP_ROWS)

    def sent(df: DataFrame) -> DataFrame:
        rows = df.where(has_vector(vec_col, sparse)).select(*key_cols, vector_id(df, id_col), F.col(ordc).alias("_ord"), *_vec_cols(df, vec_col, sparse))
        if not sparse:
            return rows
        return materialize(packed(rows, dims))

    qsel = sent(queries)
    hsel = qsel if history is queries else sent(history)
    vnames, groups = (["_p"], GROUPS_PACKED) if sparse else (["_v"], GROUPS)
    pairs = _range_pairs if asof_col is not None else _hash_pairs
    qx, hx, grp = pairs(qsel, hsel, key_cols, block_rows, group_rows, vnames, groups)
    # Fresh attribute ids on both sides: they derive from the same input.
    qx = qx.select(*[F.col(c).alias(c) for c in qx.columns])
    hx = hx.select(*[F.col(c).alias(c) for c in hx.columns])
    schema = T.StructType([queries.schema[c] for c in key_cols] + [
        T.StructField("q_id", qsel.schema["_id"].dataType), T.StructField("h_id", hsel.schema["_id"].dataType),
        T.StructField("score", T.DoubleType())])
    fn = _block_topk_fn(key_cols, k, threshold, asof_col is not None, exclude_same_id, dims, block_rows)
    scored = qx.groupBy(*grp).cogroup(hx.groupBy(*grp)).applyInPandas(fn, schema)
    if k is None:   # every pair at or above the threshold
        return scored.withColumnRenamed("q_id", "query_id").withColumnRenamed("h_id", "match_id")
    w = Window.partitionBy(*key_cols, "q_id").orderBy(F.desc("score"), "h_id")
    return (scored.withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= k)
                  .withColumnRenamed("q_id", "query_id")
                  .withColumnRenamed("h_id", "match_id"))
