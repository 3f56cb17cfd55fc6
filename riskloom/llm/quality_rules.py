"""Operator 6: quality rules by divergence from language references.

A document's characters fall into classes and its words into common words of
four languages or none of them. The reference of a language is, for each bin,
the median share over all documents of that language that pass the base rules
and are long enough; medians hold against a third of junk or copies. A document
is kept if the Jensen-Shannon distance (base 2, 0 to 1) of its histogram from
the nearest reference is within the limit, for characters and for words; either
is judged only on documents long enough to have a histogram.

Cases: null and empty texts have no words and fail the base rules; repeated
rows are each judged; a null language takes part in no reference but is judged
by the nearest; without any reference the base rules decide alone; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, ROW, WORDS, gram_hashes, row_id, saved, without

MIN_WORDS, MAX_REPEATED = 50, 0.5
MIN_CHARS, MIN_COMMON = 200, 300  # characters, words: shorter histograms are not judged
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.17, 0.3
# Frequent function words.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on at are from this or an not",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec pas ce il",
    "es": "de la que el en y a los se del las un por con una su para es al lo como",
}
BINS = sorted({w for words in COMMON.values() for w in words.split()})
_BIN = {w.encode(): i for i, w in enumerate(BINS)}
# Character classes of UTF-8 bytes: other, lower or digit (numbers and codes in prose are no junk), upper, space, sentence
# mark, symbol, non-ASCII letter (lead byte).
CLASSES = 7
_CLASS = np.zeros(256, np.uint8)
for _name, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t\n\r\x0b\x0c", b".,;:!?'\"()-",
                                b"#*$%&|<>@^_=+~`/\\[]{}", bytes(range(0xC0, 0x100))), 1):
    _CLASS[list(_bytes)] = _name
_CONTINUATION = slice(0x80, 0xC0)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    freq = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(text) - int(freq[list(b" \t\n\r\x0b\x0c")].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 2:
        h = gram_hashes(WORDS.array(words), 3)
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(n[back] > 1)
        inside = np.zeros(len(words), bool)
        for i in range(3):
            inside[twice + i] = True
        repeated = int(inside.sum())
    return len(words), chars, int(freq[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated


def histograms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts by character class, and by common word with all other words last."""
    data = text.encode()
    freq = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    freq[_CONTINUATION] = 0
    chars = np.bincount(_CLASS, weights=freq, minlength=CLASSES)
    words = Counter(ALNUM.findall(data.lower()))
    common = np.array([words.get(w, 0) for w in _BIN], float)
    return chars, np.append(common, sum(words.values()) - common.sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of ``p`` from ``q``."""
    p, q = p / np.maximum(p.sum(-1, keepdims=True), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(-1)
        return np.sqrt(np.maximum(0, (kl(p) + kl(q)) / 2))


def _measured(rows: DataFrame) -> DataFrame:
    """Counts and histograms of each row, in one scan."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, chars, words = [], [], []
            for text in b["text"]:
                text = text.as_py() or ""
                counts.append(base_counts(text))
                c, w = histograms(text)
                chars.append(c)
                words.append(w)
            yield pa.RecordBatch.from_arrays(
                [b[ROW], b["doc_id"], b["lang"], *(pa.array([c[i] for c in counts], pa.int64()) for i in range(5)),
                 pa.array(chars, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.float64()))],
                names=[ROW, "doc_id", "lang", *_COUNTS, "chars", "words"])

    return rows.mapInArrow(measure, f"{ROW} long, doc_id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", chars array<double>, words array<double>")


def references(measured: DataFrame, min_common: int = MIN_COMMON) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per language the median share of each bin over all its documents that pass the base rules (a row per language)."""
    ok = measured.where(f"lang is not null and n_words >= {min_common} and n_repeat_words <= {MAX_REPEATED} * n_words")
    def medians(col: str, n: int) -> list:
        total = F.aggregate(col, F.lit(0.0), lambda a, x: a + x)
        return [F.percentile_approx(F.try_divide(F.col(col)[i], total), 0.5, 1000).alias(f"{col}{i}") for i in range(n)]
    n = len(BINS) + 1
    got = ok.groupBy("lang").agg(*medians("chars", CLASSES), *medians("words", n)).collect()
    return [(np.array([r[f"chars{i}"] for i in range(CLASSES)], float), np.array([r[f"words{i}"] for i in range(n)], float)) for r in got]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
          min_chars: int = MIN_CHARS, min_common: int = MIN_COMMON) -> DataFrame:
    """(_row, doc_id, the base counts, base_failed, char_distance, word_distance, kept); a distance is null where it is not judged."""
    rows = docs.select(row_id(docs), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    measured = saved(_measured(rows))
    refs = docs.sparkSession.sparkContext.broadcast(references(measured, min_common))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            chars = b["chars"].flatten().to_numpy().reshape(n, CLASSES)
            words = b["words"].flatten().to_numpy().reshape(n, len(BINS) + 1)
            far = [np.min([js_distance(x, ref[i]) for ref in refs.value], axis=0) if refs.value and n else np.zeros(n) for i, x in enumerate((chars, words))]
            short = [chars.sum(1) < min_chars if n else np.zeros(0, bool), words.sum(1) < min_common if n else np.zeros(0, bool)]
            yield pa.RecordBatch.from_arrays([b[c] for c in (ROW, "doc_id", *_COUNTS)] + [pa.array(x, mask=s) for x, s in zip(far, short)],
                                             names=[ROW, "doc_id", *_COUNTS, "char_distance", "word_distance"])

    return (measured.drop("lang").mapInArrow(compare, f"{ROW} long, doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", char_distance double, word_distance double")
            .withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or n_repeat_words > {MAX_REPEATED} * n_words"))
            .withColumn("kept", F.expr(f"not base_failed and coalesce(char_distance, 0) <= {max_char} and coalesce(word_distance, 0) <= {max_word}")))


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    return without(docs, lambda docs: judge(docs, **settings).where("not kept"))
