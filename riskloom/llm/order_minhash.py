"""Operator 7: near-duplicate documents by Order MinHash.

A text's words (runs of 0-9, a-z and non-ASCII characters, A-Z lowered) give
its shingles of five words, each labelled with its number of occurrence. A
sketch takes the two labelled shingles of least hash, in text order; a text has
``SKETCHES`` of them under different hashes. At similarity 0.8 two texts agree
in one sketch with probability about 0.64, so they share none of 12 with 5e-6.

1. Texts of equal words are collapsed to one representative.
2. Representatives that share a sketch are candidates. A bucket of up to
   ``BUCKET`` texts pairs them all. A larger one pairs each text with its most
   central member (the text whose sketches most others share) and is split by
   the following sketch into smaller buckets; these pair all their texts, or,
   if still large, each with a member chosen by hash. So a group of any size
   costs a bounded number of pairs per text.
3. Candidates are verified by alignment: the longest common subsequence of
   their shingles without labels, so that a shingle may match any equal one,
   and similarity is its length over the union of both, at least 0.8. It is at
   most the Jaccard similarity of the shingles counted as often as they occur,
   and equal to it where order is kept. Where no shingle repeats, it is the
   longest increasing run of the common shingles' places within a band.
4. Connected components over verified links give classes. A large bucket whose
   texts are all in one class is settled. Elsewhere the texts outside the
   bucket's largest class are compared with all its texts, in blocks; first
   those are left out that have more shingles of their own (in no other text)
   than a link allows. The links found there complete the classes.

Cases: null, empty and wordless texts are each a class of their own; texts of
fewer than five words are one shingle; repeated rows are one class; a null id
is as good as any (the class id is the least id that is not null); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, MULT, ROW, WORDS, bitmap_of, gram_hashes, in_bitmap, mixed, rows_of, saved, without
from .components import components

SHINGLE, SKETCHES, PICKED, SIMILARITY, BUCKET = 5, 12, 2, 0.8, 48
SHARD, BLOCK_TEXTS, BLOCK_SHINGLES = 500_000, 512, 500_000
COLUMNS = 4096  # bits of a number in `aligned`


def plain_shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Shingle hashes in text order."""
    return gram_hashes(WORDS.array(words), min(k, len(words))) if words else np.empty(0, np.uint64)


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingle hashes labelled with their number of occurrence; first ones stay as they are."""
    if not len(h):
        return h
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    if nth.any():
        labels = np.empty(len(h), np.uint64)
        labels[order] = nth
        with np.errstate(over="ignore"):
            h = np.where(labels > 0, mixed(h + labels * MULT), h)
    return h


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Occurrence-labelled shingle hashes in text order."""
    return labelled(plain_shingles(words, k))


def sketches(labelled: np.ndarray, n: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """n Order MinHash sketches: the hash of the ``picked`` least labelled shingles, in text order."""
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = mixed(labelled ^ (np.uint64(j + 1) * MULT))
            at = np.sort(np.argpartition(h, picked - 1)[:picked]) if len(h) > picked else np.arange(len(h))
            value = np.uint64(j)
            for x in labelled[at]:
                value = mixed(np.array([value * MULT + x]))[0]
            out[j] = value
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over blocks of ``COLUMNS`` columns."""
    codes = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    a, b = codes[:len(a)], codes[len(a):]
    n = min(len(a), len(b))
    head = int(np.append(a[:n] != b[:n], True).argmax())
    tail = int(np.append(a[head:][::-1][:n - head] != b[head:][::-1][:n - head], True).argmax())
    ends, a, b = head + tail, a[head:len(a) - tail], b[head:len(b) - tail]
    a, b = a[np.isin(a, b)], b[np.isin(b, a)].tolist()
    carry = bytearray(len(b))
    for at in range(0, len(a), COLUMNS):
        block, places = a[at:at + COLUMNS].tolist(), {}
        for i, x in enumerate(block):
            places[x] = places.get(x, 0) | 1 << i
        width = len(block)
        row = full = (1 << width) - 1
        for j, y in enumerate(b):
            here = places.get(y, 0)
            if here or carry[j]:
                met = row & here
                total = row + met + carry[j]
                carry[j] = total >> width
                row = total & full | row - met
        ends += width - row.bit_count()
    return ends


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, plain_a: np.ndarray | None = None, plain_b: np.ndarray | None = None) -> float:
    """Share of shingles that the best alignment of two texts matches; where it is below ``least``, any number below.

    ``a`` and ``b`` are labelled sequences; ``plain_a`` and ``plain_b`` the
    ones without labels, or None where no shingle repeats.
    """
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = len(a) + len(b)
    # labelled shingles in common are as many as any alignment can match
    if len(at_a) < least * (both - len(at_a)):
        return 0.0
    if (np.diff(at_b[np.argsort(at_a)]) > 0).all():
        n = len(at_b)
    elif plain_a is not None or plain_b is not None:
        n = aligned(a if plain_a is None else plain_a, b if plain_b is None else plain_b)
    else:
        # a match further off the diagonal than this leaves too few shingles to reach `least`
        near = np.abs(at_a - at_b) <= int((1 - least) * max(len(a), len(b))) + 1
        at_b = at_b[near][np.argsort(at_a[near])]
        tails: list[int] = []
        for x in at_b.tolist():
            i = bisect_left(tails, x)
            tails[i:i + 1] = [x]
        n = len(tails)
    return n / (both - n)


def _hashes(binary: pa.Scalar) -> np.ndarray | None:
    return np.frombuffer(binary.as_buffer(), np.uint64) if binary.is_valid else None


def _buckets(docs: DataFrame) -> DataFrame:
    """(_row, j, v, next, n): the sketches that several representatives share, and how many do. ``docs``: (_row, sketches)."""
    each = docs.select(ROW, "sketches", F.posexplode("sketches").alias("j", "v")).select(
        ROW, "j", "v", F.expr("sketches[(j + 1) % size(sketches)]").alias("next"))
    sizes = each.groupBy("j", "v").agg(F.count("*").alias("n")).where("n > 1")
    return saved(each.join(sizes, ["j", "v"]))


def _candidates(shared: DataFrame, bucket: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of representatives to verify. ``shared``: what ``_buckets`` gives."""

    def paired(rows: DataFrame, keys: list[str]) -> DataFrame:
        return (rows.select(*keys, F.col(ROW).alias("a")).join(rows.select(*keys, F.col(ROW).alias("b")), keys)
                .where("a < b").select("a", "b"))

    def starred(rows: DataFrame, keys: list[str], order: F.Column) -> DataFrame:
        centre = rows.groupBy(*keys).agg(F.max_by(ROW, order).alias("c"))
        return (rows.join(centre, keys).where(f"c != {ROW}")
                .select(F.least(ROW, "c").alias("a"), F.greatest(ROW, "c").alias("b")))

    pairs = paired(shared.where(F.col("n") <= bucket), ["j", "v"])
    large = shared.where(F.col("n") > bucket)
    if not large.isEmpty():
        central = large.groupBy(ROW).agg(F.sum("n").alias("central"))
        parts = large.groupBy("j", "v", "next").agg(F.count("*").alias("m"))
        large = saved(large.join(central, ROW).join(parts, ["j", "v", "next"]))
        pairs = (pairs.unionByName(starred(large, ["j", "v"], F.struct("central", F.xxhash64(ROW))))
                 .unionByName(paired(large.where((F.col("m") > 1) & (F.col("m") <= bucket)), ["j", "v", "next"]))
                 .unionByName(starred(large.where(F.col("m") > bucket), ["j", "v", "next"], F.xxhash64(ROW, "j"))))
    return pairs.distinct()


def _lone(seqs: DataFrame, n_shards: int) -> DataFrame:
    """(_row, n_lone): how many of a text's labelled shingles no other text of ``seqs`` (_row, seq) has.

    Only those that are alone in their batch are dealt to shards, so a frequent
    shingle is sent at most once per batch.
    """

    def singles(h: np.ndarray) -> np.ndarray:
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[order][1:] != h[order][:-1], [True]])
        return order[new[1:] & new[:-1]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in b["seq"]]
            if sum(map(len, parts)):
                h, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
                at = singles(h)
                h, owner = h[at], owner[at]
                shard = (mixed(h) % np.uint64(n_shards)).astype(np.int64)
                order = np.lexsort((shard, owner))
                h, owner, shard = h[order], owner[order], shard[order]
                cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(shard) != 0)) + 1
                first = np.concatenate([[0], cuts])[:len(h)]
                yield pa.RecordBatch.from_arrays([b[ROW].take(pa.array(owner[first])), pa.array(shard[first]), pa.array([x.tobytes() for x in np.split(h, cuts)][:len(first)], pa.binary())],
                                                 names=[ROW, "shard", "h"])

    def count(dealt: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in dealt["h"]]
        owner = np.repeat(dealt[ROW].to_numpy(), [len(x) for x in parts])
        rows, n = np.unique(owner[singles(np.concatenate(parts))], return_counts=True)
        return pa.table({ROW: pa.array(rows, pa.int64()), "n": pa.array(n, pa.int64())})

    return (seqs.mapInArrow(deal, f"{ROW} long, shard long, h binary").groupBy("shard").applyInArrow(count, f"{ROW} long, n long")
            .groupBy(ROW).agg(F.sum("n").alias("n_lone")))


def _across(large: DataFrame, docs: DataFrame, seqs: DataFrame, roots: DataFrame, least: float) -> DataFrame | None:
    """Links (u, v) between texts of different classes that share a large bucket; None if all buckets are settled.

    ``large``: (_row, j, v); ``docs``: (_row, n_shingles, sketches); ``seqs``:
    (_row, seq, plain) of the texts in ``large``; ``roots``: (u, root). Two texts of x
    and y shingles need least / (1 + least) * (x + y) in common, and a shingle
    that no other text has is in no pair; texts that cannot reach that number
    are left out. Of each bucket the largest class and the other texts are cut
    into blocks, and each block of others meets all blocks.
    """

    def needed(x, y):
        return least / (1 + least) * (x + y) - 1e-6

    def unsettled(rows: DataFrame) -> DataFrame:
        classes = rows.groupBy("cell", "root").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"), F.min("n_shingles").alias("short"))
        cells = (classes.groupBy("cell").agg(F.count("*").alias("k"), F.min("short").alias("short"), F.sum("m").alias("m"), F.sum("s").alias("s"),
                                             F.max_by(F.struct("root", "m", "s"), F.struct("m", "root")).alias("main")).where("k > 1"))
        blocks = [F.greatest(F.ceil(m / BLOCK_TEXTS), F.ceil(s / BLOCK_SHINGLES)).cast("long").alias(name)
                  for name, m, s in (("others", F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")), ("mains", F.col("main.m"), F.col("main.s")))]
        return rows.join(cells.select("cell", "short", F.col("main.root").alias("main"), *blocks), "cell")

    classed = docs.join(roots.withColumnRenamed("u", ROW), ROW, "left").select(ROW, "n_shingles", F.coalesce("root", ROW).alias("root"))
    rows = saved(unsettled(large.select(ROW, "j", F.xxhash64("j", "v").alias("cell")).join(classed, ROW)).select(ROW, "j", "cell", "root", "n_shingles", "short"))
    texts = rows.select(ROW, "n_shingles").distinct()
    total = texts.agg(F.sum("n_shingles")).first()[0]
    if not total:
        return None
    lone = _lone(seqs.select(ROW, "seq").join(texts.select(ROW), ROW, "left_semi"), 1 + total // SHARD)
    rows = (rows.join(lone, ROW, "left").withColumn("common", F.col("n_shingles") - F.coalesce("n_lone", F.lit(0)))
            .where(F.col("common") >= needed(F.col("n_shingles"), F.greatest(F.col("short"), least * F.col("n_shingles")))).drop("short", "n_lone"))
    rows = unsettled(saved(rows)).drop("short")
    nth = F.pmod(F.xxhash64(ROW), F.when(F.col("root") == F.col("main"), F.col("mains")).otherwise(F.col("others")))
    rows = (rows.withColumn("block", nth + F.when(F.col("root") == F.col("main"), F.col("others")).otherwise(0))
            .withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("root") == F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
            .select(ROW, "j", "cell", "root", "n_shingles", "common", "block", F.least("block", "partner").alias("x"), F.greatest("block", "partner").alias("y"))
            .join(docs.select(ROW, "sketches"), ROW).join(seqs, ROW))

    def compare(t: pa.Table) -> pa.Table:
        j, x, y = t["j"][0].as_py(), t["x"][0].as_py(), t["y"][0].as_py()
        ids, root, n, common, block = (t[c].to_numpy() for c in (ROW, "root", "n_shingles", "common", "block"))
        signs = np.array(t["sketches"].to_pylist(), np.int64)
        seq, plain = ([_hashes(b) for b in t[c]] for c in ("seq", "plain"))
        a, b = np.flatnonzero(block == x), np.flatnonzero(block == y)
        ok = (root[a][:, None] != root[b]) & (np.minimum(common[a][:, None], common[b]) >= needed(n[a][:, None], n[b]))
        if x == y:
            ok &= ids[a][:, None] < ids[b]
        for i in range(j):  # a pair is compared in the first bucket that it shares
            ok &= signs[a, i][:, None] != signs[b, i]
        found, parent = [], {}

        def top(r: int) -> int:
            while r in parent:
                r = parent[r]
            return r

        for p, q in np.argwhere(ok):
            p, q = a[p], b[q]
            u, v = top(int(root[p])), top(int(root[q]))
            if u != v and similarity(seq[p], seq[q], least, plain[p], plain[q]) >= least:
                parent[u] = v
                found.append((int(ids[p]), int(ids[q])))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return rows.groupBy("cell", "x", "y").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, doc_id, class_id, n_links, keep): per row its class, the links found for its text, and whether it is the one that stays.

    Links are found until classes are complete, not between all texts of a class.

    ``class_id`` is the least id of the class (null if all are null); the row
    that stays has it, and of several such rows the first.
    """
    rows = rows_of(docs, id_col, text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, signs, sizes = [], [], []
            for text in b["text"]:
                words = ALNUM.findall(text.as_py().encode().lower())
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                signs.append(sketches(shingles(words)).view(np.int64) if words else None)
                sizes.append(max(1, len(words) - SHINGLE + 1))
            yield pa.RecordBatch.from_arrays([b[ROW], b["doc_id"], pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                                             names=[ROW, "doc_id", "key", "sketches", "n_shingles"])

    signed = saved(rows.mapInArrow(sign, f"{ROW} long, doc_id long, key binary, sketches array<long>, n_shingles long"))
    equal = saved(signed.where("key is not null").groupBy("key")
                  .agg(F.min(ROW).alias("rep"), F.first("sketches").alias("sketches"), F.first("n_shingles").alias("n_shingles")))
    texts = equal.select(F.col("rep").alias(ROW), "sketches", "n_shingles")
    shared = _buckets(texts)
    pairs = saved(_candidates(shared, bucket))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(
        pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("h")), "h"))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_bitmap(wanted.value, b["h"].to_numpy().view(np.uint64))))
            plain = [plain_shingles(ALNUM.findall(t.as_py().encode().lower())) for t in b["text"]]
            seqs = [labelled(h) for h in plain]
            plain = [None if h is x else h.tobytes() for h, x in zip(plain, seqs)]
            yield pa.RecordBatch.from_arrays([b[ROW], pa.array([x.tobytes() for x in seqs], pa.binary()), pa.array(plain, pa.binary())], names=[ROW, "seq", "plain"])

    seqs = saved(rows.select(ROW, F.xxhash64(ROW).alias("h"), "text").mapInArrow(sequences, f"{ROW} long, seq binary, plain binary"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(_hashes(x), _hashes(y), least, _hashes(p), _hashes(q)) >= least for x, y, p, q in zip(b["sa"], b["sb"], b["pa"], b["pb"])]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        return saved(pairs.join(seqs.select(F.col(ROW).alias("a"), F.col("seq").alias("sa"), F.col("plain").alias("pa")), "a")
                     .join(seqs.select(F.col(ROW).alias("b"), F.col("seq").alias("sb"), F.col("plain").alias("pb")), "b")
                     .select("a", "b", "sa", "sb", "pa", "pb").mapInArrow(verify, "u long, v long"))

    links = verified(pairs)
    roots = components(links)
    more = _across(shared.where(F.col("n") > bucket), texts, seqs, roots, least)
    if more is not None and not (more := saved(more)).isEmpty():
        links = links.unionByName(more).distinct()
        roots = components(links)
    degrees = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    reps = (equal.select("key", "rep").join(roots.withColumnRenamed("u", "rep"), "rep", "left").join(degrees, "rep", "left")
            .select("key", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    member = saved(signed.select(ROW, "doc_id", "key").join(reps, "key", "left")
                   .select(ROW, "doc_id", F.coalesce("root", ROW).alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    classes = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("least"))
    return member.join(classes, "root").select(ROW, "doc_id", F.col("least.doc_id").alias("class_id"), "n_links", (F.col(ROW) == F.col(f"least.{ROW}")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each class."""
    return without(docs, lambda docs: near_duplicates(docs, **settings).where("not keep"))
