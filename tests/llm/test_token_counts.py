"""Token counts of the compiled transducer against the tokenizer library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, _row string, chunk string, n_tokens string, part int"
ODD = ["a  b\n\n c\t d \x1c e f  ", "  lead", "Σας ΟΔΟΣ. x<|endoftext|> y", "<|startoftext|><|endoftext|>a<|endoftext", "don't I'll 'S ''s  　x  ", "a,'s b.'t x²,3½! é, _a_, 12a, it's,'s",
       "İ İ KÅ Å. İ́.", "", "\x00\x01 \x7f", "a" * 300, "ab" * 200, "-=" * 150, "日本語テキスト 한국어 ไทย", "😀👍🏽 🇩🇪", "́x ́", "﻿x​ y z", "x y\u0085z", "'re'RE'Re"]


@pytest.fixture(scope="module")
def plain():
    library = Tokenizer.from_file(PATH)
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


def test_counts_are_the_librarys(plain):
    counts, rng = token_counts.WordCounts(PATH), random.Random(3)
    pools = ["abcdefghijklmnopqrstuvwxyz", "aeiounrstl", "aab", "aA'sStT,.! 012", "éüñßçÀÈİıſĶ́ 'a", "".join(map(chr, range(32, 1400))), "<|endoftx>a ", "日本語한ไท😀‍️ x", ".-_=*#'\"/\\"]
    texts = ODD + ["".join(rng.choices(rng.choice(pools), k=rng.randint(0, 60))) for _ in range(12000)]
    for text in texts:
        assert counts.count(text) == plain(text), text


def test_states_may_be_forgotten(plain):
    counts, rng = token_counts.WordCounts(PATH), random.Random(4)
    counts.machine.max_states = 50
    for _ in range(300):
        text = "".join(rng.choices("aeiounrstl ", k=200))
        assert counts.count(text) == plain(text)
        assert len(counts.machine.states) <= 50


def test_maps_compose_in_any_order(plain):
    counts, rng = token_counts.WordCounts(PATH), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("aeiounrst'.\t \néİ́", k=rng.randint(1, 60)))
        parts = [token_counts.chunk_map(text[i:i + 7], counts.count) for i in range(0, len(text), 7)]
        while len(parts) > 1:
            at = rng.randrange(len(parts) - 1)
            parts[at:at + 2] = [token_counts.compose(parts[at], parts[at + 1], counts.count)]
        assert token_counts.closed(parts[0], counts.count) == plain(text)


@pytest.mark.parametrize("chunk", (5, 64, 1 << 16))
def test_whole_texts(spark, plain, chunk):
    rng = random.Random(6)
    words = [f"w{i}ord" for i in range(50)] + ["naïve", "İ", "<|endoftext|>", "don't"]
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 120)))) for i in range(30)]
    rows += [(7, None), (7, "twice here"), (7, "twice here"), (None, "a null id"), (200, "x" * 1000), (201, " " * 300)]
    if chunk > 64:
        rows.append((202, " ".join(rng.choices(words, k=60_000))))
    docs = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA).repartition(4)
    got = token_counts.token_counts(docs, PATH, limit=50, chunk=chunk).collect()
    want = [(i, len((t or "").encode()), plain(t or ""), plain(t or "") > 50) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0
