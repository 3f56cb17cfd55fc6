"""Operator 8: URL rules by Bloom filter cascades.

A rule (``net/``, ``example.com/de/``) is a host and a path prefix; it fits its
host and all subdomains where the url's path starts with the prefix. The keys a
url could be listed under are each suffix of its host with each prefix of its
path that is as long as some rule's path. The universe is the distinct keys of
all pages.

For each verdict a cascade is built over that universe: level 0 encodes the
listed keys; level 1 the unlisted keys of the universe that pass level 0; level
2 the listed keys that pass level 1; and so on until no key passes falsely. A
page is then judged inside its own task: a key is listed if the first level that
rejects it has an odd number (or none rejects it and the levels are odd in
number), which is exact for every key of the universe, without a join. The
filters' size follows the rule list (times the logarithm of the universe), and
so does what is broadcast.

Cases: null urls and urls without ``://`` have empty host and path and fit no
rule; an empty rule list gives every page the default verdict; repeated rows
are each judged; of rules that fit, the longest wins, then the longest host; a
rule listed under both verdicts blocks; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {i: i + 32 for i in range(65, 91)}
VERDICTS = ("block", "allow")


def host_path(url: str | None) -> tuple[str, str]:
    m = _URL.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys a url could be listed under, longest first."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    keys = {h + path[:n]: len(h) for h in hosts for n in lengths if n <= len(path)}
    return sorted(keys, key=lambda k: (-len(k), -keys[k]))


def _slots(key: str, level: int, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key, seed=level)
    a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
    return [((a + i * b) & 0xFFFFFFFFFFFFFFFF) % bits for i in range(hashes)]


def _level(keys: DataFrame, level: int, n: int, p: float) -> tuple[int, int, np.ndarray]:
    """A Bloom filter of ``n`` keys: bits, hashes, words. The driver gets at most a row per word."""
    hashes = max(1, round(-math.log2(p)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([x for key in b["key"].to_pylist() for x in _slots(key, level, bits, hashes)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array((np.uint64(1) << (s & 63).astype(np.uint64)).view(np.int64))], names=["at", "bit"])

    got = keys.mapInArrow(place, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bits, hashes, words


def _passes(key: str, i: int, level: tuple[int, int, np.ndarray]) -> bool:
    bits, hashes, words = level
    return all(int(words[s >> 6]) >> (s & 63) & 1 for s in _slots(key, i, bits, hashes))


def listed(key: str, cascade: list[tuple[int, int, np.ndarray]]) -> bool:
    """Whether a key of the universe is one of the cascade's listed keys."""
    for i, level in enumerate(cascade):
        if not _passes(key, i, level):
            return i % 2 == 1
    return len(cascade) % 2 == 1


def _passing(keys: DataFrame, i: int, level: tuple[int, int, np.ndarray]) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([_passes(k, i, shared.value) for k in b["key"].to_pylist()], pa.bool_()))

    return keys.mapInArrow(keep, "key string")


def build_cascade(universe: DataFrame, keys: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """Levels that separate ``keys`` from all other keys of ``universe`` (both: distinct ``key``)."""
    n, size = keys.count(), universe.count()
    if not n:
        return []
    levels, inside, outside = [_level(keys, 0, n, min(0.5, n / (math.sqrt(2) * max(1, size))))], keys, universe
    outside = saved(_passing(universe, 0, levels[0]).join(keys, "key", "left_anti"))
    while True:
        left = outside if len(levels) % 2 else inside
        n = left.count()
        if not n:
            return levels
        i = len(levels)
        levels.append(_level(left, i, n, 0.5))
        if i % 2:
            inside = saved(_passing(inside, i, levels[i]))
        else:
            outside = saved(_passing(outside, i, levels[i]))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict); ``rules``: (verdict, rule) with verdict block or allow.

    The rules come from the caller, so their number is known and bounded; the
    path lengths in use are at most as many.
    """
    spark, rules = pages.sparkSession, sorted(set(rules))
    lengths = sorted({len(r) - r.index("/") for _, r in rules}, reverse=True)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array(sorted({k for u in b["url"].to_pylist() for k in keys_of(*host_path(u), lengths)}), pa.string())})

    universe = saved(urls.select("url").mapInArrow(spread, "key string").distinct())
    made = {v: build_cascade(universe, spark.createDataFrame([(r,) for kind, r in rules if kind == v], "key string")) for v in VERDICTS}
    cascades = spark.sparkContext.broadcast(made)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url in b["url"].to_pylist():
                host, path = host_path(url)
                found = next(((k, v) for k in keys_of(host, path, lengths) for v in VERDICTS if listed(k, cascades.value[v])), (None, default))
                out.append((host, path, *found))
            host, path, rule, verdict = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([b["page_id"], *(pa.array(c, pa.string()) for c in (host, path, rule, verdict))], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
