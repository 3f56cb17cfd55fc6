"""Shared pieces of the text operators: row ids, word hashes, k-gram hashes,
window minima and a fixed-size bitmap of hashes.

Row ids come from ``monotonically_increasing_id`` over a Parquet scan. They are
the same each time the scan runs as long as its file splits are; ``row_id``
pins those for the session.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

ROW = "_row"
# Runs of 0-9, a-z and non-ASCII bytes, after bytes.lower() (which lowers A-Z only).
ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MAX_CACHED_WORDS = 200_000
MIN_SPLITS = "spark.sql.files.minPartitionNum"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id(df: DataFrame) -> Column:
    """The id of each row of ``df``, a Parquet scan (with any columns left out).

    Unless ``MIN_SPLITS`` is set, Spark sizes file splits by the cores at hand,
    which change when an executor is lost: a second scan would then number the
    rows otherwise. So it is set, once for the session.
    """
    spark = df.sparkSession
    if spark.conf.get(MIN_SPLITS, None) is None:
        spark.conf.set(MIN_SPLITS, str(max(64, spark.sparkContext.defaultParallelism)))
    return F.monotonically_increasing_id().alias(ROW)


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, doc_id, text) of ``df``: whatever other columns it has are left out."""
    return df.select(row_id(df), F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def without(docs: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with all its columns, but without the rows whose ``_row`` is in ``rows(docs)``.

    A scan has the same row ids each time it runs; anything else is written once before.
    """
    plan = docs._jdf.queryExecution().analyzed().toString().strip()
    if "\n" in plan or not plan.startswith("Relation"):
        docs = saved(docs)
    gone, own = rows(docs), ROW
    while own in docs.columns:
        own += "_"
    return docs.withColumn(own, row_id(docs)).join(gone.select(F.col(ROW).alias(own)), own, "left_anti").drop(own)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder."""
    return materialize(df)


class WordHash(dict):
    """bytes -> 64-bit hash of every word seen by this worker, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        claim(self)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHash()
_IN_USE: list[dict] = [WORDS]


def claim(cache: dict) -> None:
    """A worker that is used again for another operator drops what the last one has kept: one cache at a time."""
    if _IN_USE[0] is not cache:
        _IN_USE[0].clear()
        _IN_USE[0] = cache


class ByteCharacters(dict):
    """Code point -> the characters that stand for its UTF-8 bytes: a byte by itself where it is printable Latin-1, else by one from U+0100 on."""

    def __missing__(self, point: int) -> str:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        said = "".join(chr(b) if b in plain else chr(256 + b - sum(p < b for p in plain)) for b in chr(point).encode())
        self[point] = said
        return said


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values: a polynomial by doubling, then mixed."""
    if len(h) < k:
        return h[:0]
    out, done, power, block, size = None, 0, MULT, h, 1
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        while size <= k:
            if k & size:
                part = block[done:done + n]
                out = part if out is None else out * power + part
                done += size
            if 2 * size <= k:
                block = block[:-size] * power + block[size:]
            power, size = power * power, 2 * size
        return mixed(out)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w consecutive values, in log2(w) passes."""
    if len(h) < w:
        return h[:0]
    n, size, block = len(h) - w + 1, 1, h
    while 2 * size <= w:
        block = np.minimum(block[:-size], block[size:])
        size *= 2
    return np.minimum(block[:n], block[w - size:w - size + n])


def winnowed(h: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each window of ``length`` words its fingerprint: the least k-gram hash inside.

    Two windows of equal words have equal fingerprints, so every shared span of
    at least ``length`` words shares one.
    """
    k = min(k, length)
    return window_min(gram_hashes(h, k), length - k + 1)


def bitmap_of(keys: DataFrame, column: str, log2_bits: int = 26) -> np.ndarray:
    """A fixed-size set of 64-bit hashes with false positives, to be broadcast and probed inside tasks.

    Its size does not depend on the data (2**log2_bits bits), so broadcasting it
    is bounded at any scale; callers check its answers exactly afterwards. Spark
    ORs the bits; the driver gets at most 2**log2_bits / 64 rows.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1).cast("long"))
    got = (keys.select(F.shiftright(slot, 6).cast("int").alias("at"),
                       F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
           .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow())
    words = np.zeros(1 << (log2_bits - 6), np.uint64)
    words[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return words


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(64 * len(words) - 1)
    return ((words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
