"""Operator 1: benchmark decontamination by winnowing.

Every window of ``length`` words has a fingerprint, the least k-gram hash in
it, so a shared span of ``length`` words always shares a fingerprint. Spark ORs
the benchmark's fingerprints into a bitmap of fixed size; the scan of the
documents keeps the windows whose fingerprint is in it, and these are joined
with the benchmark's windows on their words, so the result is exact. Joined
windows extend to the whole hit: a word inside any of them counts.

An item shorter than ``length`` is one window of its own length, with its own
fingerprints; there are at most ``length`` - 1 such lengths.

Cases: null and empty texts have no words and no hit; an empty benchmark hits
nothing; repeated rows and null ids each get their own result; repeated items
are all named; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, ROW, WORDS, bitmap_of, in_bitmap, rows_of, saved, winnowed, without

LENGTH, K = 10, 5


def _windows(words: list[bytes], length: int, k: int, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(window length, fingerprint of each window) for every length in use."""
    h = WORDS.array(words)
    for n in lengths:
        if len(words) >= n:
            yield n, winnowed(h + np.uint64(n), n, k if n == length else min(k, n))


def _benchmark_windows(items: DataFrame, length: int, k: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"item_id": [], "n": [], "fp": [], "key": []}
            for item, text in zip(b["doc_id"].to_pylist(), b["text"]):
                words = ALNUM.findall(text.as_py().encode().lower())
                if not words:
                    continue
                for n, fps in _windows(words, length, k, [min(length, len(words))]):
                    out["item_id"] += [item] * len(fps)
                    out["n"] += [n] * len(fps)
                    out["fp"] += fps.view(np.int64).tolist()
                    out["key"] += [b" ".join(words[i:i + n]).decode() for i in range(len(fps))]
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(out["item_id"], pa.int64()), "n": pa.array(out["n"], pa.int32()),
                                              "fp": pa.array(out["fp"], pa.int64()), "key": pa.array(out["key"], pa.string())})

    return items.mapInArrow(cut, "item_id long, n int, fp long, key string").distinct()


def find_contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(_row, doc_id, n_words, n_hit, n_items, items, spans): per document its hit words, items and hit word spans."""
    windows = saved(_benchmark_windows(rows_of(items, item_col, item_text_col), length, k))
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most `length` values
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(windows, "fp"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found = [], []
            for text in b["text"]:
                words = ALNUM.findall(text.as_py().encode().lower())
                sizes.append(len(words))
                got = []
                for n, fps in _windows(words, length, k, lengths):
                    got += [(i, i + n, b" ".join(words[i:i + n]).decode()) for i in np.flatnonzero(in_bitmap(bitmap.value, fps)).tolist()]
                found.append([{"at": i, "to": j, "key": key} for i, j, key in got])
            yield pa.RecordBatch.from_arrays(
                [b[ROW], b["doc_id"], pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32()), ("key", pa.string())])))],
                names=[ROW, "doc_id", "n_words", "found"])

    scanned = saved(rows_of(docs, id_col, text_col).mapInArrow(scan, f"{ROW} long, doc_id long, n_words long, found array<struct<at:int,to:int,key:string>>"))
    seeds = scanned.where(F.size("found") > 0).select(ROW, F.inline("found"))
    hits = saved(seeds.join(windows.select("key").distinct(), "key", "left_semi"))
    spans = hits.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("spans"))
    end = F.aggregate("spans", F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to")),
                      lambda a, s: F.struct((a.hit + F.greatest(F.lit(0), s.to - F.greatest(s["at"], a["to"]))).alias("hit"), F.greatest(a["to"], s.to).alias("to")))
    named = (hits.select(ROW, "key").distinct().join(windows.select("key", "item_id").distinct(), "key").select(ROW, "item_id").distinct()
             .groupBy(ROW).agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items")))
    return (scanned.drop("found").join(spans.select(ROW, end["hit"].cast("long").alias("n_hit"), "spans"), ROW, "left").join(named, ROW, "left")
            .select(ROW, "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("spans", F.array().cast("array<struct<at:int,to:int>>")).alias("spans")))


def drop_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that hold a window of any item."""
    return without(docs, lambda docs: find_contamination(docs, items, **settings).where("n_hit > 0"))
