"""Operator 11: importance resampling of documents towards a target text, without replacement.

Features are runs of words, hashed into ``buckets`` (CRC-32). Their counts over
all documents and over the target are arrays of that size; a bucket's gain is
the log ratio of its smoothed shares, in thousandths, and a document's weight
the floored mean gain of its features. Gumbel noise from a hash of seed and id
turns weights into scores whose highest ones are a weighted draw.

The order of the scores comes from a distributed LSD radix sort. The composite
key (score downwards, id upwards) is cut into digits. For each digit, least
significant first, one stable counting-sort pass runs over blocks of equal size:
Spark counts (digit, block), the counts' global prefix sums are the first
destinations, and each block, read in its order, deals its rows to the next
ones. A row's last destination is its rank. A block is a partition by itself,
so equal keys never meet in one task beyond a block's rows, and a repeated task
gives the same destinations.

Cases: null and empty texts have no features and weight 0; a null id hashes as
the empty text and stands before other ids; repeated rows are each ranked; an
empty table gives no rows, an empty target counts no feature; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, saved

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
DIGIT_BITS = 11
BLOCK_ROWS = 1_000_000
_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def features(text: bytes, buckets: int = BUCKETS, max_run: int = 1) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each run of 1 to ``max_run`` words."""
    words = ALNUM.findall(text.lower())
    runs = words if max_run == 1 else [b" ".join(words[i:i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def _texts(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")


def feature_counts(docs: DataFrame, buckets: int = BUCKETS, max_run: int = 1, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket; each task counts into one array, the driver gets a row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(features(text.as_py(), buckets, max_run)[1], minlength=buckets)
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(total[bucket])], names=["bucket", "n"])

    got = docs.select(_texts(docs, text_col)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * (s_all + n) / (float(s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, max_run: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    plan = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = plan.value
        for batch in batches:
            ids, rows = batch["doc_id"].to_pylist(), []
            for doc_id, text in zip(ids, batch["text"]):
                n_words, at = features(text.as_py(), len(gain), max_run)
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                rows.append((n_words, len(at), weight, weight + noise(doc_id, seed)))
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, cols)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _texts(docs, text_col)).mapInArrow(score, _SCORED)


def counting_pass(rows: DataFrame, key: str, shift: int, bits: int, blocks: int, per_block: int) -> DataFrame:
    """Rows with (_block, _at) after a stable sort by ``bits`` bits of ``key``: ``_at`` is the place, ``_block`` its block."""
    digit = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int").alias("_digit")
    rows = rows.select("*", digit)
    counts = rows.groupBy("_digit", "_block").agg(F.count("*").alias("n"))
    totals = np.zeros(1 << bits, np.int64)
    for r in counts.groupBy("_digit").agg(F.sum("n").alias("n")).collect():
        totals[r._digit] = r.n
    first = np.concatenate([[0], np.cumsum(totals)[:-1]])
    earlier = F.sum("n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("n")
    heads = counts.select("_digit", "_block", F.lit(-1).cast("long").alias("_at"), earlier.alias("_start"))
    kept = [c for c in rows.columns if c not in ("_digit", "_block", "_at")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, goes = None, None
        for batch in batches:
            of, at, d = (batch[c].to_numpy() for c in ("_block", "_at", "_digit"))
            to = np.full(len(of), -1, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if of[lo] != block:
                    block, goes = of[lo], first.copy()
                head = lo + int((at[lo:hi] < 0).sum())  # a block's offsets stand before its rows
                goes[d[lo:head]] += batch["_start"][lo:head].to_numpy()
                mine = d[head:hi]
                order = np.argsort(mine, kind="stable")
                n = np.bincount(mine, minlength=len(goes))
                nth = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
                to[head + order] = goes[mine[order]] + nth
                goes += n
            moved = to >= 0
            out = batch.select(kept).filter(pa.array(moved))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array((to[moved] // per_block).astype(np.int32)), pa.array(to[moved])], names=[*kept, "_block", "_at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept, "_block", "_at").schema)
    return (rows.withColumn("_start", F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)
            .repartitionById(blocks, F.col("_block")).sortWithinPartitions("_block", "_at").mapInArrow(deal, schema))


def radix_sorted(rows: DataFrame, keys: list[tuple[str, int]], block_rows: int = BLOCK_ROWS, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` (written already) with ``_at``, the 0-based rank by ``keys``, most significant first.

    A key is a column of unsigned longs and the bits that any of its values need.
    """
    spark, n = rows.sparkSession, rows.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block_rows))
    per_block = max(1, -(-n // blocks))
    # The first order is any: a partition's rows in turn to each block.
    rows = (rows.withColumn("_at", F.monotonically_increasing_id())
            .withColumn("_block", (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long")) % blocks).cast("int")))
    done = False
    for key, bits in reversed(keys):
        passes = -(-bits // digit_bits)
        width = -(-bits // passes) if passes else 0
        for shift in range(0, bits, width or 1):
            rows, done = counting_pass(saved(rows) if done else rows, key, shift, min(width, bits - shift), blocks, per_block), True
    return rows if done else counting_pass(rows, keys[0][0], 0, 1, blocks, per_block)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_run: int = 1,
             seed: int = SEED, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``percent`` of the documents with ``min_words`` words are drawn; ``rank`` is null for the rest."""
    gain = gains(feature_counts(docs, buckets, max_run, text_col), feature_counts(target, buckets, max_run, text_col))
    rows = saved(scored(docs, gain, max_run, seed, id_col, text_col))
    fit = rows.where(F.col("n_words") >= min_words)
    of = fit.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("doc_id").alias("ids")).first()
    out = ["doc_id", "n_features", "weight", "score"]
    rest = rows.where(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank"))
    if not of.n:
        return rest
    least, most = of.least or 0, of.most or 0
    narrow = most - least < 1 << 63  # else offsets overflow, and the sign bit is turned instead
    keyed = (fit.withColumn("_score", F.lit(of.high) - F.col("score")).withColumn("_has_id", F.col("doc_id").isNotNull().cast("long"))
             .withColumn("_id", F.coalesce(F.col("doc_id") - F.lit(least) if narrow else F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))), F.lit(0)).cast("long")))
    ranked = radix_sorted(keyed, [("_score", (of.high - of.low).bit_length()), ("_has_id", int(of.ids < of.n)), ("_id", (most - least).bit_length() if narrow else 64)], block_rows)
    drawn = percent * of.n // 100
    return ranked.select(*out, F.when(F.col("_at") < drawn, F.col("_at") + 1).alias("rank")).unionByName(rest)
