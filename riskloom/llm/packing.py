"""Operator 4: vector best-fit packing of documents into sequences.

A document's pieces need room in three capacities of a sequence: tokens,
documents and attention cost (the sum of squared lengths). Pieces are placed
longest first; among the open sequences that hold a piece under every
constraint, the one with the least weighted residual norm after placing it is
taken. Pieces of one length are alike, so the placement works on the histogram
of lengths (at most ``capacity`` entries whatever the table's size): the driver
sees that histogram alone, and lays whole runs of equal pieces at once. The
pieces then find their places by their rank among pieces of their length,
which Spark counts by task.

Cases: null text is empty and gives the end id alone; repeated rows are each
packed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .tokens import encoder

CAPACITY = 2048
WEIGHTS = (1.0, 1e-3, 1e-3)  # tokens decide; documents and attention cost break ties
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long"


def place(counts: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None,
          weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Segments (length, first rank, first sequence, pieces per sequence, offset) of the packing.

    The pieces of a length with ranks from one segment's first rank on go to
    consecutive sequences, so many to each, from the offset on.
    """
    full = np.array([capacity, max_docs or capacity, max_cost or capacity * capacity], np.int64)
    scale = np.array(weights) / full
    free, first, many, opened, out = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0, []
    for length in sorted(counts, reverse=True):
        left, need, rank = counts[length], np.array([length, 1, length * length], np.int64), 0
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((free >= need).all(1) & (many > 0))
            if len(fits):
                score = (((free[fits] - need) * scale) ** 2).sum(1)
                g = fits[np.argmin(score)]
                room, start, n = free[g], first[g], int(many[g])
            else:
                g, room, start, n = -1, full, opened, left
            each = int((room // need).min())
            used = min(n, -(-left // each))
            put = min(left, used * each)
            out.append((length, rank, start, each, capacity - int(room[0])))
            whole, rest = divmod(put, each)
            made = [(room - need * each, start, whole)] + ([(room - need * rest, start + whole, 1)] if rest else [])
            if g < 0:
                opened += used
            elif used == n:
                many[g] = 0
            else:
                first[g], many[g] = start + used, n - used
            made = [m for m in made if m[2] and (m[0] > 0).all()]
            if made:
                free, first, many = np.vstack([free, *[m[0] for m in made]]), np.append(first, [m[1] for m in made]), np.append(many, [m[2] for m in made])
            rank, left = rank + put, left - put
        keep = many > 0
        free, first, many = free[keep], first[keep], many[keep]
    return np.array(out, np.int64).reshape(-1, 5)


def pieces_of(docs: DataFrame, tokenizer: str, kind: str, end_id: int = 0, capacity: int = CAPACITY,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, with its rank among the pieces of its length in its task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer, kind), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = enc.encode(text.as_py() or "", end_id)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    n = len(cut) // 4
                    rank = seen[n] = seen.get(n, -1) + 1
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(cut), part, rank))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, _PIECES)


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 0, capacity: int = CAPACITY, max_docs: int | None = None,
         max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece with its place.

    ``max_docs`` and ``max_cost`` bound a sequence's documents and attention cost;
    by default they allow whatever the token capacity allows.
    """
    pieces = saved(pieces_of(docs, tokenizer, kind, end_id, capacity, id_col, text_col))
    by_task = pieces.groupBy("_part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = place(histogram, capacity, max_docs, max_cost, weights)
    order = np.lexsort((segments[:, 1], segments[:, 0]))
    plan = docs.sparkSession.sparkContext.broadcast(segments[order])
    before = by_task.select("_part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_before"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = plan.value
        key = (seg[:, 0] << np.int64(46)) + seg[:, 1]
        for b in batches:
            length, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            s = seg[np.searchsorted(key, (length << np.int64(46)) + rank, side="right") - 1]
            seq, nth = np.divmod(rank - s[:, 1], np.maximum(s[:, 3], 1))
            yield pa.RecordBatch.from_arrays([b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(s[:, 2] + seq), pa.array(s[:, 4] + nth * length)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return (pieces.join(before, ["_part", "length"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
            .mapInArrow(settle, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
