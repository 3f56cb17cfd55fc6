"""Operator 2: token ids as Arrow stream files of equal-length sequences.

Documents are range-partitioned and sorted by id, encoded, and each partition
writes one shard: ``shard-N.arrows``, an Arrow stream whose record batches hold
``ids`` and ``mask`` as fixed-size lists (so sequence i of a batch lies at a
known place and is read without copying), and ``shard-N.docs.arrows`` with each
document's place. A shard is written under an attempt's own name and renamed,
so a lost or repeated task leaves whole files. ``manifest.json`` has the id
count of each shard, from which the global starts follow.

A mask bit is 1 for an id and 0 for the padding after a shard's last id.

Cases: null text is empty and gives the end id alone; null ids come first;
repeated rows each get their place (ties ordered by text); an empty table gives
shards without sequences; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .tokens import encoder

SEQ_LEN = 2048
BATCH_SEQS = 64
_WROTE = "shard int, n_docs long, n_tokens long, n_seqs long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(seq_len: int, id_bytes: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if id_bytes == 2 else pa.uint32(), seq_len)),
                      ("mask", pa.list_(pa.bool_(), seq_len))])


def _names(root: str, shard: int) -> tuple[pafs.FileSystem, str, str]:
    fs, base = pafs.FileSystem.from_uri(root)
    return fs, f"{base}/shard-{shard:05d}.arrows", f"{base}/shard-{shard:05d}.docs.arrows"


def write_token_files(docs: DataFrame, root: str, tokenizer: str, kind: str = "byte", end_id: int = 0,
                      seq_len: int = SEQ_LEN, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text",
                      shards: int | None = None) -> list[int]:
    """Encode ``docs`` into shards under ``root`` (a folder all executors share); ids per shard.

    ``id_bytes`` 2 holds vocabularies up to 65,536 ids, 4 all others. The driver
    only sees one row per shard.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    schema, dtype = _schema(seq_len, id_bytes), np.dtype(f"<u{id_bytes}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, enc = task.partitionId(), encoder(tokenizer, kind)
        fs, seqs_at, docs_at = _names(root, shard)
        tmp = f".{task.taskAttemptId()}.tmp"
        rest, total, n_docs, n_seqs = np.empty(0, dtype), 0, 0, 0
        with fs.open_output_stream(seqs_at + tmp) as f, fs.open_output_stream(docs_at + tmp) as g, \
                pa.ipc.new_stream(f, schema) as seqs, pa.ipc.new_stream(g, _DOCS) as places:

            def put(ids: np.ndarray, n: int) -> None:
                mask = np.arange(len(ids)) < n
                seqs.write_batch(pa.RecordBatch.from_arrays(
                    [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in zip((ids, mask), schema.types)],
                    schema=schema))

            size = BATCH_SEQS * seq_len
            for batch in batches:
                encoded = [enc.encode(text.as_py() or "", end_id) for text in batch["text"]]
                counts = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
                ids = np.frombuffer(b"".join(encoded), "<u4")
                if id_bytes == 2 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("ids over 65,535: use id_bytes=4")
                places.write_batch(pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(total + np.cumsum(counts) - counts), pa.array(counts)], schema=_DOCS))
                total, n_docs = total + len(ids), n_docs + batch.num_rows
                rest = np.concatenate([rest, ids.astype(dtype)])
                whole = len(rest) // size
                for i in range(whole):
                    put(rest[i * size:(i + 1) * size], size)
                rest, n_seqs = rest[whole * size:], n_seqs + whole * BATCH_SEQS
            if len(rest):
                last = -(-len(rest) // seq_len)
                put(np.pad(rest, (0, last * seq_len - len(rest))), len(rest))
                n_seqs += last
        for name in (seqs_at, docs_at):
            fs.move(name + tmp, name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_tokens": [total], "n_seqs": [n_seqs]})

    wrote = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
             .repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
             .mapInArrow(write, _WROTE).collect())
    tokens = [0] * (1 + max((r.shard for r in wrote), default=-1))
    for r in wrote:
        tokens[r.shard] = r.n_tokens
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"seq_len": seq_len, "end_id": end_id, "tokens": tokens}).encode())
    return tokens


def open_shard(root: str, shard: int) -> pa.Table:
    """The sequences of a shard; on a local file system mapped, not copied."""
    fs, name, _ = _names(root, shard)
    source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
    return pa.ipc.open_stream(source).read_all()


def sequence(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, pa.Array]:
    """Ids of sequence ``i`` of a batch (a view of the file's bytes) and its mask."""
    n = batch.schema.field("ids").type.list_size
    at = batch["ids"].offset + i
    return batch["ids"].values.to_numpy(zero_copy_only=True)[at * n:(at + 1) * n], batch["mask"].values[at * n:(at + 1) * n]


def read_token_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files, a task per shard."""
    fs, base = pafs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        tokens = json.loads(f.read())["tokens"]
    before = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (int(x) for b in batches for x in b["id"].to_pylist()):
            fs, seqs_at, docs_at = _names(root, shard)
            with fs.open_input_stream(seqs_at) as f, fs.open_input_stream(docs_at) as g:
                seqs, rest = pa.ipc.open_stream(f), np.empty(0, np.uint32)
                for docs in pa.ipc.open_stream(g):
                    crcs = []
                    for n in docs["n_tokens"].to_pylist():
                        while len(rest) < n:
                            rest = np.concatenate([rest, seqs.read_next_batch()["ids"].values.to_numpy().astype("<u4")])
                        crcs.append(zlib.crc32(rest[:n].tobytes()))
                        rest = rest[n:]
                    yield pa.RecordBatch.from_arrays(
                        [docs["doc_id"], pa.array(docs["start"].to_numpy() + before[shard]), docs["n_tokens"], pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = len(tokens)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_root(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
