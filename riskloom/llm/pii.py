"""Operator 9: personal data, also in disguise, with offsets into the source text.

Base identifiers are found in the text itself. Then a chain of transducers
rewrites the text and keeps, for every character it writes, the source span it
stands for: homoglyphs and full-width forms become ASCII one to one; spelled
digits, and at and dot in brackets or words, become one character each. The
finders run again over the rewritten text; what they find in rewritten places
is mapped back to source offsets and added, unless a base span of its kind
covers it. Base spans stay as they are.

No identifier and no disguise reaches over a line's end, so only lines are
rewritten that show enough evidence for one: a disguised mark beside an at sign or
digits, digit words with the digits that an identifier needs, a character that
stands for another.

A lone word ``at`` counts only before a name with a disguised dot whose last part
is a word, not a number. Lone words for dots make an address of numbers only if
all three are disguised, and ``point`` only between spelled digits. Spelled
digits count in runs of any length, also next to digits and dots, and ``plus``
before either; the finders decide whether they make an identifier. As a digit
word may also be plain prose beside an identifier, the finders run over the
line with and without spelled digits rewritten: a number that is whole without
a lone digit word at its end does not take it, a card is tried without lone
digit words at its ends, and an email takes them only if its at is disguised.

Offsets are code points, end exclusive. Cases: null is empty and has no spans;
repeated rows are each searched; the finders take time in proportion to the
text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Matches of a greedy run start where the run does, so the guards only save time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = str.maketrans(
    "авеһіјкӏмопԛрсѕтуѵԝхԁԍАВЕНІЈКМОРЅСТУХаɑαеοορνυγιɡ",
    "abehijklmonqpcstuvwxdgABEHIJKMOPSCTYXaaaeoopvuyig")
# Other forms of the at sign and the full stop; characters without width.
_MARK_FORMS = str.maketrans("﹫。｡﹒", "@...")
_NO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digit names in English, German, French and Spanish.
_SPELLED = {"zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
            "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
            "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
            "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9}
_DIGIT = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_OPEN, _CLOSE = r"[ \t]{0,3}[(\[{<][ \t]{0,3}", r"[ \t]{0,3}[)\]}>][ \t]{0,3}"
_DOT_WORD = r"(?:dot|punkt|point|punto)"
_DOT = rf"(?:{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}|[ \t]{{1,3}}{_DOT_WORD}[ \t]{{1,3}})"
_MARKS = (rf"(?P<at>{_OPEN}(?:at|@){_CLOSE})|(?P<at_word>(?<=[A-Za-z0-9])[ \t]{{1,3}}at[ \t]{{1,3}}(?=[A-Za-z0-9-]{{1,63}}{_DOT}))"
          rf"|(?P<dot>(?<=[A-Za-z0-9]){_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}(?=[A-Za-z0-9]))"
          rf"|(?P<dot_word>(?<=[A-Za-z0-9])[ \t]{{1,3}}{_DOT_WORD}[ \t]{{1,3}}(?=[A-Za-z0-9]))|(?P<gone>[{_NO_WIDTH}]+)")
_REWRITES = re.compile(_MARKS, re.I)
_SPELLING = re.compile(rf"(?P<spelled>(?<![^\W_])(?:plus[ -]{{1,2}})?{_DIGIT}(?:[ ,-]{{1,2}}{_DIGIT})*+(?![^\W_])|(?<![^\W_])plus[ -]{{1,2}}(?=[0-9]))|{_MARKS}", re.I)
_BRACKET = re.compile(rf"[(\[{{<][ \t]{{0,3}}(?:at|@|\.|{_DOT_WORD})", re.I)
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_DIGIT_WORDS = frozenset(w for x in (*_SPELLED, "plus") for w in (x.encode(), x.upper().encode().lower()))
_BLANKED = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b > 127 else 32 for b in range(256))
_WORD = re.compile(r"[^\W_]+")


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """Base identifiers of a text: (kind, start, end), by kind and start."""
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            done = m.end()
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) < 4 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


class _Forms(dict):
    """Code point -> the ASCII character it stands for, or itself."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        if point in _LOOKALIKES or point in _MARK_FORMS:
            to = (_LOOKALIKES | _MARK_FORMS)[point]
        elif "！" <= c <= "～":
            to = point - 0xFEE0
        else:
            to = point if point < 128 or unicodedata.decimal(c, None) is None else 48 + unicodedata.decimal(c)
        self[point] = to
        return to


_FORMS = _Forms()


def _ascii(text: str) -> str:
    """Homoglyphs, full-width forms, foreign digits and marks as ASCII, one character for one."""
    if text.isascii() or all(_FORMS[ord(c)] == ord(c) for c in set(text)):
        return text
    return text.translate(_FORMS)


def _digit_words(text: str) -> bool:
    """Whether a digit's name, or ``plus``, is among the words."""
    if text.isascii():
        return not _DIGIT_WORDS.isdisjoint(text.encode().translate(_BLANKED).split())
    return any(w in _SPELLED or w == "plus" for w in _WORD.findall(text.lower()))


def _marks(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in _DOT_WORDS) or _BRACKET.search(text) is not None


# How a run of the rewritten text came about: as in the source, or what it stands for.
PLAIN, DIGIT, PLUS, AT, AT_WORD, DOT, DOT_WORD = "", "digit", "plus", "at", "at_word", "dot", "dot_word"


def deobfuscated(plain: str, spelled: bool = True) -> tuple[str, list[int], list[int], list[str]]:
    """A line of ``_ascii`` text rewritten, and its runs: where each starts there, where in the source, and what it is. Digit words stay unless ``spelled``."""
    out, at, src, new, pos, size = [], [], [], [], 0, 0

    def put(piece: str, source: int, what: str) -> None:
        nonlocal size
        if piece:
            out.append(piece)
            at.append(size)
            src.append(source)
            new.append(what)
            size += len(piece)

    for m in (_SPELLING if spelled else _REWRITES).finditer(plain):
        put(plain[pos:m.start()], pos, PLAIN)
        if m.lastgroup == "spelled":
            for w in _WORD.finditer(m[0]):
                digit = w[0].lower() != "plus"
                put(str(_SPELLED[w[0].lower()]) if digit else "+", m.start() + w.start(), DIGIT if digit else PLUS)
        elif m.lastgroup != "gone":
            put("@" if m.lastgroup in (AT, AT_WORD) else ".", m.start(), m.lastgroup)
        pos = m.end()
    put(plain[pos:], pos, PLAIN)
    return "".join(out), at, src, new


def _found(text: str, plain: str, spelled: bool) -> list[tuple[str, int, int]]:
    """Identifiers of a rewritten line that the source does not show as they are, in source offsets."""
    norm, at, src, new = deobfuscated(plain, spelled)
    if norm == text:
        return []

    def word(i: int) -> bool:
        return new[i] == DIGIT

    def lone(i: int) -> bool:
        return word(i) and not (i and word(i - 1)) and not (i + 1 < len(at) and word(i + 1))

    def run(k: int) -> int:
        return bisect_right(at, k) - 1

    spans = find(norm)
    if spelled:
        cards = {(s, e) for k, s, e in spans if k == "card"}
        for m in _CARD.finditer(norm):
            if m.span() not in cards:
                s, e = m.span()
                starts = [s, s + len(norm[s + 1:e]) - len(norm[s + 1:e].lstrip(" -")) + 1] if lone(run(s)) else [s]
                ends = [e, s + len(norm[s:e - 1].rstrip(" -"))] if lone(run(e - 1)) else [e]
                spans += [("card", a, b) for a in starts for b in ends if (a, b) != (s, e) and ("card", 0, b - a) in find(norm[a:b])][:1]
    out = []
    for kind, s, e in spans:
        i, j = run(s), run(e - 1)
        if kind == "phone" and lone(j) and not any(map(word, range(i, j))):
            shorter = norm[s:e - 1].rstrip(" ().-")
            if ("phone", 0, len(shorter)) in find(shorter):
                e = s + len(shorter)
                j = run(e - 1)
        if kind == "email":
            how = new[run(s + norm[s:e].index("@"))]
            tail = norm[s:e].rpartition(".")[2]
            if how == PLAIN and any(map(word, range(i, j + 1))):
                continue
            if how == AT_WORD and (not tail.isalpha() or len(tail) < 2 or tail.lower() in _SPELLED):
                continue
        if kind == "ip":
            dots = [run(k) for k in range(s, e) if norm[k] == "."]
            if any(new[k] == DOT_WORD for k in dots):
                said = any("point" in plain[src[k]:src[k] + 9].lower() for k in dots if new[k] == DOT_WORD)
                if any(new[k] not in (DOT, DOT_WORD) for k in dots) or said and not any(map(word, range(i, j + 1))):
                    continue
        start = src[i] + (s - at[i])
        if new[j]:  # the last run stands for a word or a bracketed mark: up to the next run
            end = src[j] + len(_WORD.match(plain, src[j])[0]) if _WORD.match(plain, src[j]) else (src[j + 1] if j + 1 < len(src) else len(plain))
        else:
            end = src[j] + (e - at[j])
        if norm[s:e] != text[start:end]:
            out.append((kind, start, end))
    return out


def _enough(plain: str, spelled: bool, marks: bool) -> bool:
    """Whether a line has what an identifier needs at least: an at sign, or four digits."""
    if "@" in plain or _BRACKET.search(plain) or marks and " at " in plain.lower().replace("\t", " "):
        return True
    figures = len(_NOT_DIGIT.sub("", plain))
    if spelled and figures < 4:
        figures += sum(w.lower() in _SPELLED for w in _WORD.findall(plain))
    return figures >= 4


def added(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that only the rewritten text shows, in source offsets."""
    plain = _ascii(text)
    hidden = not text.isascii() and any(c in text for c in _NO_WIDTH)
    if not (plain != text or hidden or _marks(plain) or _digit_words(plain)):
        return []

    def covered(span: tuple[str, int, int], by: list[tuple[str, int, int]]) -> bool:
        return any(k == span[0] and a <= span[1] and span[2] <= b for k, a, b in by)

    out, start = [], 0
    for line in plain.split("\n"):
        end = start + len(line)
        source = line if plain is text else text[start:end]
        spelled, marks = _digit_words(line), _marks(line)
        if (source != line or hidden or spelled or marks) and _enough(line, spelled, marks):
            near = [x for x in base if start <= x[1] and x[2] <= end]
            got = [(k, s + start, e + start) for k, s, e in _found(source, line, spelled)]
            got = [x for x in got if not covered(x, near)]
            if spelled:
                more = [(k, s + start, e + start) for k, s, e in _found(source, line, False)]
                got += [x for x in more if not covered(x, near) and not covered(x, got)]
            out += got
        start = end + 1
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): per row its spans by kind and start, base ones marked."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b["text"]:
                text = text.as_py() or ""
                base = find(text)
                both = [(KINDS.index(k), s, e, True) for k, s, e in base] + [(KINDS.index(k), s, e, False) for k, s, e in added(text, base)]
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": x} for k, s, e, x in sorted(both)])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, _SPANS)], names=["doc_id", "spans"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(search, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>"))


def redacted(text: str) -> str:
    base = find(text)
    out, pos = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e in base + added(text, base)):
        if s >= pos:
            out += [text[pos:s], f"<{kind.upper()}>"]
        pos = max(pos, e)
    return "".join([*out, text[pos:]]) if out else text


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else redacted(t))


def redact(text: Column) -> Column:
    """``text`` with each identifier replaced by its kind in angle brackets; null stays null."""
    return _redact(text)
