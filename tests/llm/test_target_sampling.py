"""Importance resampling and its radix sort against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from riskloom.llm import target_sampling
from riskloom.llm.common import saved

SCHEMA = "doc_id long, text string, _at string, _block int, n_words string, score string, _id long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def runs(text, most):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, items, most=1):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(text, most))
    for text in items:
        t.update(runs(text, most))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        f = runs(text, most)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = Counter()
    out = [(*r[:4], i + 1 if i < 10 * len(fit) // 100 else None) for i, r in enumerate(fit)]
    return sorted(out + [(*r[:4], None) for r in rows if not r[4]], key=repr), rank


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ünï", "Word", "WORD"]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 80)))) for i in range(n)]


@pytest.mark.parametrize("most", (1, 2))
def test_draw_matches_brute_force(spark, most):
    docs = corpus(400, 1)
    docs += [(None, docs[0][1]), (-5, docs[1][1]), (2**62, docs[2][1]), (900, None), (901, ""), (902, "\x00 ,. "), (7, docs[7][1]), (903, "w1 " * 60000), *[(950, "w3 w4 " * 20)] * 130]
    items = [t for _, t in corpus(20, 2)] + [None, ""]
    frame = spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in docs], SCHEMA).repartition(5)
    got = target_sampling.resample(frame, spark.createDataFrame([(t, "x") for t in items], "text string, bucket string"), max_run=most, block_rows=40).collect()
    want, _ = brute(docs, items, most)
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(r.rank is not None for r in got) > 40


def test_odd_tables(spark):
    target = spark.createDataFrame([("a b c",)], "text string")
    none = spark.createDataFrame([], SCHEMA)
    assert target_sampling.resample(none, target).count() == 0
    docs = spark.createDataFrame([(i, "a b " * 15, "x", 1, "y", "z", 2) for i in range(30)], SCHEMA)
    assert target_sampling.resample(docs, target.limit(0)).where("rank is not null").count() == 3
    assert target_sampling.resample(docs.where("doc_id < 5"), target).where("rank is not null").count() == 0
    wide = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, -(2**63) + F.col("doc_id")).otherwise(2**63 - 1 - F.col("doc_id")))
    got = target_sampling.resample(wide, target, percent=100).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [r.doc_id for r in sorted(got, key=lambda r: (-r.score, r.doc_id))]


@pytest.mark.parametrize("digit_bits", (3, 8, 16))
def test_radix_sort_orders_composite_keys(spark, digit_bits):
    rng = random.Random(digit_bits)
    rows = [(rng.randrange(8), rng.randrange(5000) if i % 3 else 7, i) for i in range(2500)]
    frame = saved(spark.createDataFrame(rows, "a long, b long, c long").repartition(3))
    got = target_sampling.radix_sorted(frame, [("a", 3), ("b", 13)], block_rows=200, digit_bits=digit_bits).collect()
    by = sorted(got, key=lambda r: r._at)
    assert [r._at for r in by] == list(range(2500)) and sorted((r.a, r.b, r.c) for r in got) == sorted(rows)
    assert [(r.a, r.b) for r in by] == sorted((a, b) for a, b, _ in rows)
    assert {r._block for r in got} == set(range(13)) and max(Counter(r._block for r in got).values()) <= 200


def test_equal_keys_keep_their_order_and_their_blocks(spark):
    frame = saved(spark.range(900).select(F.lit(5).cast("long").alias("k"), "id").repartition(4))
    got = target_sampling.radix_sorted(frame, [("k", 0)], block_rows=100).collect()
    assert sorted(r._at for r in got) == list(range(900)) and len({r._block for r in got}) == 9
