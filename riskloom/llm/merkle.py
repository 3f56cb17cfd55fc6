"""Operator 13: a Merkle manifest of a table, its trees stored in van Emde Boas layout.

A tree's leaves are cut into aligned subtrees of ``2**height`` leaves. Each is
one row of the manifest: the digests of its nodes, laid out recursively (the
upper half of its levels first, then each subtree of the lower half, every part
laid out the same way), so that a path from leaf to root touches few cache
lines whatever their size. ``addresses`` gives a node's place by arithmetic
alone; building a subtree and fetching siblings both go through it. The roots
of the subtrees are the leaves of the next level's subtrees, until one is left.

A node is the SHA-256 of its children's digests as lowercase hex text, left to
right; the last node of an odd level has one child. Each language has a tree,
its leaves in ascending order of id; the languages' roots, null first and then
by their bytes, are the leaves of one more tree.

No step holds a whole tree: leaves are numbered by a range sort and a count per
partition, a task builds one subtree at a time, and paths go down again by
joins of subtrees, one row each. The driver gets one row per partition.

Cases: nulls in any field count as ``-``; a null id comes first; equal ids are
ordered by leaf, so repeated rows are leaves of their own; a null language is a
tree of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from binascii import hexlify
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import saved

HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NONE, LEFT, RIGHT = 0, 1, 2  # where a node's sibling is
STEP = 33  # bytes of a path's step: one of these, then the sibling's digest
_BLOCKS = "tree string, block long, height int, n int, root binary, nodes binary, ids array<long>, tampered array<binary>"


@lru_cache
def addresses(levels: int) -> np.ndarray:
    """Place of each node of a complete tree, the nodes given breadth first."""
    if levels == 1:
        return np.zeros(1, np.int64)
    upper = levels // 2
    lower = levels - upper
    top, part, size = addresses(upper), addresses(lower), (1 << lower) - 1
    out = np.empty((1 << levels) - 1, np.int64)
    out[:len(top)] = top
    for depth in range(lower):
        node = np.arange(1 << (upper + depth))
        first = (1 << depth) - 1
        out[(1 << (upper + depth)) - 1 + node] = len(top) + (node >> depth) * size + part[first + (node & first)]
    return out


def level_addresses(height: int, level: int) -> np.ndarray:
    """Places of the nodes ``level`` steps above the leaves, left to right."""
    first = (1 << (height - level)) - 1
    return addresses(height + 1)[first:2 * first + 1]


def build(leaves: np.ndarray, height: int) -> np.ndarray:
    """The nodes (digests, in layout order) over ``leaves``; places without a node are zero."""
    nodes = np.zeros(((2 << height) - 1, 32), np.uint8)
    nodes[level_addresses(height, 0)[:len(leaves)]] = leaves
    n = len(leaves)
    for level in range(height):
        raw = nodes[level_addresses(height, level)[:n]].tobytes()
        n = -(-n // 2)
        made = b"".join(sha256(hexlify(raw[64 * i:64 * i + 64])).digest() for i in range(n))
        nodes[level_addresses(height, level + 1)[:n]] = np.frombuffer(made, np.uint8).reshape(n, 32)
    return nodes


def block_height(block: int, n: int, height: int) -> int:
    """Levels above the leaves: all of them, unless this is the only block of its tree."""
    return height if block or n == 1 << height else (n - 1).bit_length()


def local_paths(nodes: np.ndarray, n: int, height: int) -> np.ndarray:
    """(n, height * STEP) bytes: for each leaf the steps up to the block's root."""
    out = np.zeros((n, height, STEP), np.uint8)
    leaf = np.arange(n)
    for level in range(height):
        beside = (leaf >> level) ^ 1
        there = beside < -(-n // (1 << level))
        at = level_addresses(height, level)
        out[there, level, 0] = np.where(beside[there] & 1, RIGHT, LEFT)
        out[there, level, 1:] = nodes[at[beside[there]]]
    return out.reshape(n, height * STEP)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for at in range(0, len(path), STEP):
        side, beside = path[at], path[at + 1:at + STEP]
        leaf = sha256(hexlify(leaf if side == NONE else beside + leaf if side == LEFT else leaf + beside)).digest()
    return leaf


def proof_digest(path: bytes) -> bytes:
    return sha256(b"".join(hexlify(path[at + 1:at + STEP]) for at in range(0, len(path), STEP) if path[at] != NONE)).digest()


def field(value: Column) -> Column:
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", id_col: str = "doc_id",
              tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(tree, id, leaf, tampered): a leaf per row, and the leaf it would be with other values where ``where`` holds."""
    other = leaf_digest([(tampered or {}).get(f, F.col(f)) for f in fields])
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"),  # a null tree sorts first
                       F.col(id_col).cast("long").alias("id"), leaf_digest([F.col(f) for f in fields]).alias("leaf"),
                       (F.lit(None).cast("binary") if where is None else F.when(where, other)).alias("tampered"))


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``pos``, the place of each in its tree.

    A range sort leaves each tree as one run over consecutive partitions; from the
    rows that each partition has of its last tree follows where the next one starts.
    """
    spark = leaves.sparkSession
    order = ["tree", "id", "leaf", "_n"]  # _n spreads rows that are equal in all else
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = saved(saved(leaves.withColumn("_n", F.monotonically_increasing_id())).repartitionByRange(parts, *order)
                .sortWithinPartitions(*order).drop("_n")).withColumn("_part", F.spark_partition_id())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        count = 0
        for b in batches:
            trees = b["tree"].to_pylist()
            if trees:
                first, part = (trees[0], b["_part"][0].as_py()) if first is None else (first, part)
                same = len(trees) if trees[0] == trees[-1] else trees[::-1].index(next(t for t in reversed(trees) if t != trees[-1]))
                count, last = (count if last == trees[-1] == trees[0] else 0) + same, trees[-1]
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [first], "last": [last], "n": pa.array([count], pa.int64())})

    starts, tree, n = {}, None, 0
    for r in sorted(run.mapInArrow(ends, "part int, first string, last string, n long").collect(), key=lambda r: r.part):
        starts[r.part] = n if r.first == tree else 0
        n = r.n + (n if r.first == r.last == tree else 0)
        tree = r.last

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, 0
        for b in batches:
            pos = []
            for part, t in zip(b["_part"].to_pylist(), b["tree"].to_pylist()):
                if t != tree:
                    at, tree = starts[part] if tree is None else 0, t
                pos.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([b["tree"], b["id"], b["leaf"], b["tampered"], pa.array(pos, pa.int64())], names=["tree", "id", "leaf", "tampered", "pos"])

    return run.mapInArrow(number, "tree string, id long, leaf binary, tampered binary, pos long")


def digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 32)


def climb(leaves: DataFrame, path: str, height: int = HEIGHT) -> list[DataFrame]:
    """The levels of the manifest, written below ``path``; the last has one block per tree.

    ``leaves`` has (tree, id, leaf, tampered, pos); ids and tampered leaves are kept beside the first level's nodes.
    """
    spark = leaves.sparkSession

    def one(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("pos")
        block, n = group["pos"][0].as_py() >> height, group.num_rows
        high = block_height(block, n, height)
        nodes = build(digests(group["leaf"]), high)
        row = {"tree": group["tree"][:1], "block": [block], "height": pa.array([high], pa.int32()), "n": pa.array([n], pa.int32()),
               "root": [nodes[0].tobytes()], "nodes": [nodes.tobytes()], "ids": pa.array([group["id"].to_pylist()], pa.list_(pa.int64())),
               "tampered": pa.array([group["tampered"].to_pylist()], pa.list_(pa.binary()))}
        return pa.table(row)

    levels = []
    while True:
        at = f"{path}/level-{len(levels)}"
        leaves.groupBy("tree", F.shiftright("pos", height).alias("_block")).applyInArrow(one, _BLOCKS).write.parquet(at)
        levels.append(spark.read.schema(_BLOCKS).parquet(at))
        if not levels[-1].where("block > 0").limit(1).count():
            return levels
        leaves = levels[-1].select("tree", F.lit(None).cast("long").alias("id"), F.col("root").alias("leaf"),
                                   F.lit(None).cast("binary").alias("tampered"), F.col("block").alias("pos"))


def descend(levels: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The first level's blocks with the path of their roots, and the columns of ``above``: (tree, path, subroot, root)."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    schema = "tree string, block long, path binary, subroot binary, root binary"

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                paths, n = local_paths(np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32), r["n"], r["height"]), r["n"]
                first = r["block"] << height
                yield pa.RecordBatch.from_pydict({"tree": [r["tree"]] * n, "block": pa.array(range(first, first + n), pa.int64()),
                                                  "path": [p.tobytes() + r["path"] for p in paths], "subroot": [r["subroot"]] * n, "root": [r["root"]] * n})

    for level in levels[:0:-1]:
        above = level.drop("root", "ids", "tampered").join(above, ["tree", "block"]).mapInArrow(down, schema)
    return levels[0].drop("root").join(above, ["tree", "block"])


def proofs(levels: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row per leaf: (id, leaf, subroot, root, path, folded), digests in binary; ``folded`` is from the tampered leaf if there is one."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                nodes, n = np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32), r["n"]
                paths = [p.tobytes() + r["path"] for p in local_paths(nodes, n, r["height"])]
                leaves = [x.tobytes() for x in nodes[level_addresses(r["height"], 0)[:n]]]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(r["ids"], pa.int64()), "leaf": leaves, "subroot": [r["subroot"]] * n, "root": [r["root"]] * n, "proof": list(map(proof_digest, paths)),
                    "folded": [fold(leaf if other is None else other, p) for leaf, other, p in zip(leaves, r["tampered"], paths)]})

    return descend(levels, above, height).mapInArrow(out, "id long, leaf binary, subroot binary, root binary, proof binary, folded binary")


def manifest(leaves: DataFrame, path: str | None = None, height: int = HEIGHT) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of the trees, and of the tree over their roots, written below ``path``."""
    path = path or f"{ensure_checkpoint_dir(leaves.sparkSession).rstrip('/')}/merkle-{uuid.uuid4().hex}"
    trees = climb(numbered(leaves), f"{path}/trees", height)
    # The trees are sorted by name as leaves are by digest; the name then stays beside the root, in the other digest's place.
    names = numbered(trees[-1].select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("id"), F.col("tree").cast("binary").alias("leaf"), F.col("root").alias("tampered")))
    return trees, climb(names.select("tree", "id", F.col("tampered").alias("leaf"), F.col("leaf").alias("tampered"), "pos"), f"{path}/roots", height)


def verify(leaves: DataFrame, path: str | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified): every leaf folded up through its siblings, digests as lowercase hex.

    ``proof`` is the SHA-256 of the siblings' digests as hex text, level by level.
    """
    trees, roots = manifest(leaves, path, height)
    root = roots[-1].select("tree", F.lit(b"").alias("path"), F.lit(b"").alias("subroot"), "root")
    blocks = descend(roots, root, height)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                nodes, n = np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32), r["n"]
                yield pa.RecordBatch.from_pydict({
                    "tree": [t.decode() for t in r["tampered"]], "path": [p.tobytes() + r["path"] for p in local_paths(nodes, n, r["height"])],
                    "subroot": [x.tobytes() for x in nodes[level_addresses(r["height"], 0)[:n]]], "root": [r["root"]] * n})

    above = blocks.mapInArrow(named, "tree string, path binary, subroot binary, root binary")
    said = lambda c: F.lower(F.hex(c))
    return proofs(trees, above, height).select(
        "id", said("leaf").alias("leaf"), said("subroot").alias("subroot"), said("root").alias("root"), said("proof").alias("proof"),
        said("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
