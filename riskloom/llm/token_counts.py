"""Operator 12: token counts of whole texts by a transducer compiled from a BPE tokenizer file.

A piece (what the tokenizer splits texts into) is read character by character.
BPE has one tokenization per prefix, and a run of tokens is that of its text
just if each two neighbours are that of theirs. So what matters about the
characters read is where a token still to come may begin, and which token ends
there. That is a state; a transition reads a character and is annotated with the
number of tokens that every such place has before it (those are settled), a
state with the number that are left where a piece ends there. States are made
when first reached, and forgotten all together when there are too many.

White space brings every state back to the start. So the map of a chunk of text,
from the state it is entered in to the state it is left in and the tokens
between, is: the text before its first white space, a number, and the text after
its last (all of it is the first, without white space). Maps compose
associatively. Texts longer than a chunk are cut anywhere, their chunks' maps
are made in parallel, and a prefix scan composes them in doubling steps.

Cases: null text is empty and has no tokens; a special token's string inside a
text is one token, as the library's default has it; repeated rows are counted
each; an empty table gives no rows; other columns are ignored. A single piece
longer than a chunk is put together again in one task.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteCharacters, claim, row_id, saved

CHUNK = 1 << 16  # characters
MAX_STATES = 150_000
MAX_PAIRS = 250_000
MAX_WORDS = 400_000
MAX_WORD = 48
# White space of the tokenizer files; Python's also has U+001C to U+001F.
SOLID = re.compile(r"[\S\x1c-\x1f]+")
SPACE = re.compile(r"[ \t\n\r]")
# The tokenizer's split of a word into pieces, for lowered words of ASCII and composed Latin letters.
LATIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿĀ-ſ]+|[0-9]|[^a-z0-9ß-öø-ÿĀ-ſ]+")


class State(dict):
    """Character -> (next state, tokens settled).

    ``text`` has the last characters read, from the first place on where a token
    still to come may begin; ``places`` has those places: offset in ``text``, token
    that ends there (None at a piece's start) and tokens not yet settled.
    """

    __slots__ = ("machine", "text", "places", "left")

    def __init__(self, machine: "Transducer", text: str, places: tuple[tuple[int, str | None, int], ...]):
        self.machine, self.text, self.places = machine, text, places
        self.left = 0 if not text else -1

    def __missing__(self, char: str) -> tuple["State", int]:
        made = self[char] = self.machine.step(self, char)
        return made


class Transducer:
    """The tokens of one piece, by a BPE model with or without a suffix at a piece's end."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int], suffix: str, max_states: int = MAX_STATES):
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.suffix, self.max_states = suffix, max_states
        self.inner = {t for t in vocabulary if not suffix or not t.endswith(suffix)}
        self.final = {t.removesuffix(suffix) for t in vocabulary if t.endswith(suffix)} if suffix else self.inner
        self.starts = {t[:i] for t in self.inner | self.final for i in range(1, len(t) + 1)}
        self.pairs: dict[tuple[str | None, str, bool], bool] = {}
        self.forget()

    def forget(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.clear()  # states point at each other
        self.states: dict[tuple, State] = {}
        self.start = State(self, "", ((0, None, 0),))

    def merged(self, symbols: list[str]) -> list[str]:
        ranks, none = self.ranks, len(self.ranks)
        found = [ranks.get(p, none) for p in zip(symbols, symbols[1:])]
        while found:
            rank = min(found)
            if rank == none:
                break
            at = found.index(rank)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del found[at]
            if at:
                found[at - 1] = ranks.get((symbols[at - 1], symbols[at]), none)
            if at < len(found):
                found[at] = ranks.get((symbols[at], symbols[at + 1]), none)
        return symbols

    def follows(self, before: str | None, token: str, ends: bool) -> bool:
        """Whether the two are the tokenization of their text (at a piece's end, if ``ends``)."""
        key = (before, token, ends)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            symbols = [*(before or ""), *token]
            if ends:
                symbols[-1] += self.suffix
            want = [before] * (before is not None) + [token + self.suffix * ends]
            known = self.pairs[key] = self.merged(symbols) == want
        return known

    def ending(self, state: State, ends: bool) -> tuple[str, int]:
        """The last token of what ``state`` has read, and the tokens up to its end that are not settled."""
        tokens, text = self.final if ends else self.inner, state.text
        for at, before, count in state.places:
            token = text[at:]
            if token in tokens and self.follows(before, token, ends):
                return token, count + 1
        raise ValueError(f"no token of the vocabulary ends at {text!r}")

    def step(self, state: State, char: str) -> tuple[State, int]:
        places, text = state.places, state.text
        if text:  # its last character is not a piece's last one: a token may begin behind it
            places = (*places, (len(text), *self.ending(state, False)))
            text += char
        else:
            text = char
        starts = self.starts
        places = [p for p in places if text[p[0]:] in starts]
        first, settled = places[0][0], min([p[2] for p in places])
        text = text[first:]
        places = tuple([(at - first, before, count - settled) for at, before, count in places])
        key = (text, places)
        made = self.states.get(key)
        if made is None:
            if len(self.states) >= self.max_states:
                self.forget()
            made = self.states[key] = State(self, text, places)
        return made, settled

    def tokens(self, piece: str) -> int:
        state, total = self.start, 0
        for char in piece:
            state, settled = state[char]
            total += settled
        if state.left < 0:
            state.left = self.ending(state, True)[1]
        return total + state.left


class WordCounts(dict):
    """Solid run of characters -> number of tokens: its map from start to start."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", [])):
            raise ValueError("only BPE files that lower case and drop white space are known")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = Transducer(merges, model["vocab"], model["end_of_word_suffix"] or "")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.byte = ByteCharacters()

    def __missing__(self, word: str) -> int:
        n = self.run(word)
        if len(word) <= MAX_WORD:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = n
        return n

    def run(self, word: str) -> int:
        if "<|" in word:
            parts = self.special.split(word)
            if len(parts) > 1:
                return len(parts) - 1 + sum(self.run(p) for p in parts if p)
        tokens = self.machine.tokens
        if word.isascii() or LATIN.fullmatch(word):
            n = 0
            for piece in PIECES.findall(word.lower()):
                if not piece.isascii() or not piece.isprintable():
                    piece = piece.translate(self.byte)
                n += tokens(piece)
            return n
        said = self.tokenizer.normalizer.normalize_str(word)
        return sum(tokens(piece) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(said))

    def count(self, text: str) -> int:
        if "<|" not in text:  # the tokenizer lowers all letters; lowering A-Z before gives fewer different words
            text = text.lower() if text.isascii() else text.encode().lower().decode()
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return sum(map(self.__getitem__, SOLID.findall(text) if odd else text.split()))


_COUNTS: dict[str, WordCounts] = {}


@contextmanager
def uncollected() -> Iterator[None]:
    """No cyclic garbage collection: it would walk all states again and again, and ``forget`` leaves none."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def counts_of(path: str) -> WordCounts:
    """This worker's transducer for a tokenizer file."""
    if path not in _COUNTS:
        _COUNTS[path] = WordCounts(path)
    claim(_COUNTS[path])
    return _COUNTS[path]


# A chunk's map: whether white space cuts it, the text before, the tokens between and the text after.
Map = tuple[bool, str, int, str]


def chunk_map(text: str, count: Callable[[str], int]) -> Map:
    first = SPACE.search(text)
    if first is None:
        return False, text, 0, ""
    end = max(text.rfind(c) for c in " \t\n\r")
    return True, text[:first.start()], count(text[first.start():end]), text[end + 1:]


def compose(a: Map, b: Map, count: Callable[[str], int]) -> Map:
    if not b[0]:
        return (True, *a[1:3], a[3] + b[1]) if a[0] else (False, a[1] + b[1], 0, "")
    if not a[0]:
        return True, a[1] + b[1], b[2], b[3]
    return True, a[1], a[2] + count(a[3] + b[1]) + b[2], b[3]


def closed(m: Map, count: Callable[[str], int]) -> int:
    return count(m[1]) + m[2] + count(m[3])


_MAP = "_row long, chunk int, cut boolean, head string, n long, tail string"


def _scan(parts: DataFrame, tokenizer: str, most: int) -> DataFrame:
    """(_row, n_tokens) of texts given as (_row, chunk, part): inclusive prefix scan of their chunks' maps."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts_of(tokenizer).count
        for b in batches:
            cols = list(zip(*(chunk_map(p.as_py(), count) for p in b["part"]))) or [()] * 4
            yield pa.RecordBatch.from_arrays([b["_row"], b["chunk"], *(pa.array(c, t) for c, t in zip(cols, _TYPES))], names=_NAMES)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts_of(tokenizer).count
        for b in batches:
            later = zip(*(b[c].to_pylist() for c in _NAMES[2:]))
            before = zip(*(b["_" + c].to_pylist() for c in _NAMES[2:]))
            cols = list(zip(*(y if x[0] is None else compose(x, y, count) for x, y in zip(before, later)))) or [()] * 4
            yield pa.RecordBatch.from_arrays([b["_row"], b["chunk"], *(pa.array(c, t) for c, t in zip(cols, _TYPES))], names=_NAMES)

    now, step = saved(parts.repartition("_row", "chunk").mapInArrow(maps, _MAP)), 1
    while step < most:
        before = now.select("_row", (F.col("chunk") + step).alias("chunk"), *(F.col(c).alias("_" + c) for c in _NAMES[2:]))
        now, step = saved(now.join(before, ["_row", "chunk"], "left").mapInArrow(composed, _MAP)), 2 * step
    return now


_NAMES = ["_row", "chunk", "cut", "head", "n", "tail"]
_TYPES = (pa.bool_(), pa.string(), pa.int64(), pa.string())


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): the tokens of each whole text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts_of(tokenizer).count
        for b in batches:
            rows = []
            for row, doc_id, size, text in zip(b["_row"].to_pylist(), b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["text"]):
                text = text.as_py()
                if len(text) <= chunk:
                    with uncollected():
                        rows.append((row, doc_id, size, 1, 0, None, count(text)))
                else:
                    n = -(-len(text) // chunk)
                    rows += [(row, doc_id, size, n, i, text[i * chunk:(i + 1) * chunk], None) for i in range(n)]
            cols = list(zip(*rows)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["_row", "doc_id", "n_bytes", "chunks", "chunk", "part", "n_tokens"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts_of(tokenizer).count
        for b in batches:
            n = [closed(m, count) for m in zip(*(b[c].to_pylist() for c in _NAMES[2:]))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = saved(docs.select(row_id(docs), F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
                 .mapInArrow(cut, "_row long, doc_id long, n_bytes long, chunks int, chunk int, part string, n_tokens long"))
    out = rows.where("part is null").select("doc_id", "n_bytes", "n_tokens")
    most = rows.agg(F.max("chunks")).first()[0] or 1
    if most > 1:
        parts = rows.where("part is not null")
        ends = parts.where(F.col("chunk") == F.col("chunks") - 1).select("_row", "chunk", "doc_id", "n_bytes")
        out = out.unionByName(_scan(parts.select("_row", "chunk", "part"), tokenizer, most).join(ends, ["_row", "chunk"]).mapInArrow(finish, "doc_id long, n_bytes long, n_tokens long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
