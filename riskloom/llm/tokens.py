"""Encoding whole texts with a tokenizer file, one library call per distinct piece of text.

Both kinds of tokenizer cut a text at white space, and between a letter and a
following mark, before they merge, so a text may be encoded piece by piece; a
worker keeps the ids of pieces it has seen. The word tokenizer first composes
and lowers characters, which can turn a letter's end into a mark, so there only
letters that stay one letter are cut from what follows. Special tokens inside a
text get their ids, as the library gives them by default.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import compress
from operator import not_

import numpy as np

from .common import ByteCharacters, claim

MAX_CACHED_PIECES = 600_000
MARK = r"[,.;:!?|\"()*%$#&]"
PLAIN = "[A-Za-zÀ-ÖØ-öø-įı-ſ]"  # composed Latin letters, without the dotted capital I
WORD = re.compile(f" ?{PLAIN}+")


def _pieces(kind: str, letter: str, plain: str, space: str, solid: str) -> re.Pattern:
    if kind == "byte":  # byte-level BPE: a space leads its word
        return re.compile(rf" ?{letter}+(?={MARK}|[ \n]|\Z)| ?{solid}+|{space}+(?!{solid})|{space}+")
    return re.compile(rf"{letter}+(?=[ \n]|\Z)|{letter}*{plain}(?={MARK})|{solid}+")  # BPE with word ends: white space is dropped


# By kind, for ASCII and for any text. White space is as the tokenizer files know it; Python's \s also has U+001C to U+001F.
PIECES = {kind: (_pieces(kind, "[A-Za-z]", "[A-Za-z]", r"[ \t-\r]", r"[^ \t-\r]"),
                 _pieces(kind, r"[^\W\d_]", PLAIN, r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]")) for kind in ("byte", "word")}
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are laid out by array('I') as little-endian unsigned 32-bit integers")
_ENCODERS: dict[tuple[str, str], "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes texts; ``ids`` has the ids of pieces as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kind: str):
        self.ids: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.patterns = Tokenizer.from_file(path), PIECES[kind]
        self.lowers, self.byte = kind == "word", ByteCharacters()
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")")
        self.special_ids = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.opening = os.path.commonprefix(list(added)) if added else None

    def encode(self, text: str, end_id: int = 0) -> bytes:
        """Ids of the whole text and the end id."""
        end = end_id.to_bytes(4, "little")
        if self.opening is not None and self.opening in text:
            parts = self.special.split(text)
            return b"".join([self.special_ids[p] if i % 2 else self.plain(p) for i, p in enumerate(parts)]) + end
        return self.plain(text) + end

    def plain(self, text: str) -> bytes:
        simple = text.isascii()
        if self.lowers:  # the tokenizer lowers all letters; lowering A-Z before gives fewer different pieces
            text = text.lower() if simple else text.encode().lower().decode()
        pieces = self.patterns[not simple].findall(text)
        got = list(map(self.ids.get, pieces))
        if None in got:
            at = list(compress(range(len(got)), map(not_, got)))
            self.learn({pieces[i] for i in at})
            for i in at:
                got[i] = self.ids[pieces[i]]
        return b"".join(got)

    def learn(self, new: set[str]) -> None:
        if len(self.ids) + len(new) > MAX_CACHED_PIECES:
            self.ids.clear()
        tokenize, lower, other = self.tokenizer.model.tokenize, self.lowers, []
        for piece in new:
            if WORD.fullmatch(piece):  # letters alone are one piece to the tokenizer too, so the model by itself gives their ids
                said = (piece.lower() if lower else piece).translate(self.byte)
                self.ids[piece] = array("I", [t.id for t in tokenize(said)]).tobytes()
            else:
                other.append(piece)
        if not other:
            return
        new = other
        got = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        ids, cuts = np.array(got.ids, "<u4").tobytes(), (np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(new) + 1)) * 4).tolist()
        self.ids.update(zip(new, [ids[at:to] for at, to in zip(cuts, cuts[1:])]))


def encoder(path: str, kind: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = PieceEncoder(path, kind)
    claim(_ENCODERS[path, kind].ids)
    return _ENCODERS[path, kind]
