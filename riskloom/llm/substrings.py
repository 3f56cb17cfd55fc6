"""Operator 10: removal of repeated word sequences by seed and extend.

Seeds are winnowed anchors: each window of ``length`` words selects the least
k-gram hash in it, so equal windows select equal anchors. A segment is a
maximal run of windows of a document that select one anchor.

1. Scan: the anchors of all documents; those seen in two documents are OR-ed
   into a bitmap of fixed size. Documents without one are done.
2. Scan: of the other documents the segments of such anchors, with a hash of
   each window and one of the whole segment (its context).
3. Join on anchors. Segments of equal context match as a whole, both ways from
   the anchor, so one row settles all their windows. Of the segments whose
   anchor has several contexts, the first document of each context is taken
   apart into windows, and these are matched: a context's other documents have
   the same windows and are settled already.
4. The matched windows of a document join to maximal repeats, and the words
   they cover are removed.

A window counts if an equal one starts in a document with a smaller id, judged
on the input. No pairs of documents are made: every step keeps the least id of
a key, which Spark aggregates before it shuffles, so a passage that a third of
the documents share costs a row for each.

Equality is that of 128 bits (anchor and window hash).

Cases: null and empty texts have no words; texts shorter than a window keep all
words; rows of one id are one document and remove nothing from each other; a
null id neither gives nor loses words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, ROW, WORDS, bitmap_of, gram_hashes, in_bitmap, mixed, rows_of, saved, winnowed

LENGTH, K = 50, 12
_SEGMENT = "array<struct<anchor:long,context:long,at:int,hashes:array<long>>>"


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, anchors = [], []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"]):
                got = np.unique(winnowed(WORDS.array(text.as_py().encode().split()), length, k))
                ids.append(np.full(len(got), doc_id, np.int64))
                anchors.append(got)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(anchors).view(np.int64))], names=["doc_id", "anchor"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(scan, "doc_id long, anchor long")


def find_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, doc_id, n_words, kept_sha256, text, spans): spans of words to remove.

    ``text`` and ``spans`` are null for documents without a repeated anchor,
    which keep all words; ``kept_sha256`` is null for the others.
    """
    rows = rows_of(docs, id_col, text_col)
    shared = _anchors(rows, length, k).groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(shared, "anchor", 27))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, texts, segments = [], [], [], []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"]):
                text = text.as_py()
                words = text.encode().split()
                sizes.append(len(words))
                got = []
                if len(words) >= length and doc_id is not None:
                    h = WORDS.array(words)
                    chosen = winnowed(h, length, k)
                    starts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
                    hit = in_bitmap(bitmap.value, chosen[starts])
                    if hit.any():
                        grams = gram_hashes(h, length)
                        ends = np.append(starts[1:], len(chosen))
                        with np.errstate(over="ignore"):
                            nth = (np.arange(len(chosen)) - np.repeat(starts, ends - starts)).astype(np.uint64)
                            context = np.add.reduceat(mixed(grams ^ mixed(nth * MULT + MULT)), starts).view(np.int64)
                        signed, anchors = grams.view(np.int64), chosen.view(np.int64)
                        got = [{"anchor": int(anchors[s]), "context": int(context[i]), "at": int(s), "hashes": signed[s:e]}
                               for i, s, e in zip(np.flatnonzero(hit), starts[hit], ends[hit])]
                segments.append(got or None)
                texts.append(text if got else None)
                digests.append(None if got else _digest(words))
            yield pa.RecordBatch.from_arrays(
                [b[ROW], b["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()),
                 pa.array(segments, pa.list_(pa.struct([("anchor", pa.int64()), ("context", pa.int64()), ("at", pa.int32()), ("hashes", pa.list_(pa.int64()))])))],
                names=[ROW, "doc_id", "n_words", "kept_sha256", "text", "segments"])

    scanned = saved(rows.mapInArrow(scan, f"{ROW} long, doc_id long, n_words long, kept_sha256 string, text string, segments {_SEGMENT}"))
    segments = scanned.where("segments is not null").select(ROW, "doc_id", F.inline("segments"))
    contexts = segments.groupBy("anchor", "context").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    anchors = contexts.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("first").alias("a"), F.max("last").alias("z")).where("a < z").drop("a", "z")
    matched = saved(segments.join(contexts.join(anchors, "anchor").where("first < last or contexts > 1").drop("last"), ["anchor", "context"])
                    .where("first < doc_id or contexts > 1")
                    .select(ROW, "doc_id", "anchor", "at", F.size("hashes").alias("n"), (F.col("first") < F.col("doc_id")).alias("settled"),
                            F.expr("if(first < doc_id, null, hashes)").alias("hashes")))
    windows = matched.where("not settled").select(ROW, "doc_id", "anchor", "at", F.posexplode("hashes").alias("nth", "hash"))
    least = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    spans = (matched.where("settled").select(ROW, "at", (F.col("at") + F.col("n") + (length - 1)).alias("to"))
             .unionByName(windows.join(least, ["anchor", "hash"]).where("first < doc_id")
                          .select(ROW, (F.col("at") + F.col("nth")).alias("at"), (F.col("at") + F.col("nth") + length).alias("to")))
             .groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("spans")))
    candidates = scanned.where("segments is not null").drop("segments").join(spans, ROW, "left")
    return candidates.unionByName(scanned.where("segments is null").drop("segments"), allowMissingColumns=True)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): per document what is left; with ``texts`` also the kept text, null where unchanged."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, digests, kept_texts = [], [], []
            for text, digest, spans in zip(b["text"], b["kept_sha256"].to_pylist(), b["spans"].to_pylist()):
                gone, kept = 0, None
                if digest is None:
                    words = text.as_py().encode().split()
                    keep = np.ones(len(words), bool)
                    for s in spans or ():
                        keep[s["at"]:s["to"]] = False
                    gone = int(len(words) - keep.sum())
                    left = [w for w, ok in zip(words, keep.tolist()) if ok] if gone else words
                    digest, kept = _digest(left), b" ".join(left).decode() if gone and texts else None
                removed.append(gone)
                digests.append(digest)
                kept_texts.append(kept)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_words"], pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())][:4 + texts],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][:4 + texts])

    return find_repeats(docs, length, k, id_col, text_col).mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else ""))
