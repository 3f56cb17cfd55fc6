"""Sparse vectors as short byte strings, for steps that send a vector to several tasks.

A vector of 200 of 768 dimensions takes 2400 bytes as arrays of indices and
values, about 220 packed: a bitmap of its dimensions, its different values and
a number of few bits per dimension that says which of them it has. Different
values are kept as counts of two bytes where dividing the counts by their norm
gives the same doubles (``embed_hashed_sparse``), otherwise as doubles; the
vectors that come back are the same bit by bit.
"""

from __future__ import annotations

import numpy as np

WIDTHS = np.array([1, 2, 4, 8, 16, 32])
HEAD = 5        # number of different values, and whether they are counts


def _width(n: np.ndarray) -> np.ndarray:
    """Bits for a number below ``n``."""
    return WIDTHS[np.searchsorted(2 ** WIDTHS, n)]


def _counts(values: np.ndarray, code: np.ndarray) -> np.ndarray | None:
    """Whole numbers that give these values when divided by the vector's norm, or None."""
    counts = np.rint(values / values[0]) if len(values) else values
    if not ((counts >= 1) & (counts < 65536)).all():
        return None
    each = counts[code]
    return counts if (counts / np.sqrt(each @ each) == values).all() else None


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in ascending order, and the place of each value among them."""
    order = x.argsort()
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    code = np.empty(len(x), np.uint32)
    code[order] = new.cumsum() - 1
    return x[new], code


def _bits(code: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits each as bytes, the last one filled up."""
    if width >= 8:
        return code.astype(f">u{width // 8}")
    full = np.zeros(-(-len(code) * width // 8) * (8 // width), np.uint8)
    full[:len(code)] = code
    return (full.reshape(-1, 8 // width) << np.arange(8 - width, -1, -width, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)


def pack(vectors: np.ndarray) -> list[bytes]:
    """The rows of a matrix, packed."""
    there = vectors != 0
    out = []
    with np.errstate(all="ignore"):
        for row, at, bitmap in zip(vectors, there, np.packbits(there, axis=1)):
            values, code = _coded(row[at])
            counts = _counts(values, code)
            width = next(w for w in WIDTHS.tolist() if len(values) <= 2 ** w)
            out.append(len(values).to_bytes(4, "little") + (b"\1" if counts is not None else b"\0") + bitmap.tobytes()
                       + (values.astype("<f8") if counts is None else counts.astype("<u2")).tobytes() + _bits(code, width).tobytes())
    return out


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of runs of some lengths, one run after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def counted(rows: list[bytes]) -> bool:
    """Whether all these packed vectors are kept as counts."""
    return all(r[4] == 1 for r in rows)


def unpack(rows: list[bytes], dims: int, unit: bool = True) -> np.ndarray:
    """Packed vectors as the rows of a float64 matrix; without ``unit`` counts stay counts, and the matrix is float32."""
    out = np.zeros((len(rows), dims), np.float64 if unit else np.float32)
    data = np.frombuffer(b"".join(rows), np.uint8)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    start = np.cumsum(size) - size
    values_at = HEAD + (dims + 7) // 8
    head = data[start[:, None] + np.arange(values_at)]
    n = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.int64)
    there = np.unpackbits(head[:, HEAD:], axis=1, count=dims).astype(bool)
    filled, counted, width = there.sum(axis=1), head[:, 4] == 1, _width(n)
    entries = np.empty(filled.sum())
    layout = 2 * width + counted
    for z in np.unique(layout):       # rows of one layout at a time
        r, (w, c) = np.nonzero(layout == z)[0], divmod(int(z), 2)
        first, taken, code_bytes = start[r] + values_at, n[r] * (2 if c else 8), -(-filled[r] * w // 8)
        values = data[_ragged(first, taken)].view("<u2" if c else "<f8").astype(np.float64)
        codes = data[_ragged(first + taken, code_bytes)]
        if w < 8:
            codes = ((codes[:, None] >> np.arange(8 - w, -1, -w, dtype=np.uint8)) & ((1 << w) - 1)).ravel()
            codes = codes[_ragged((np.cumsum(code_bytes) - code_bytes) * (8 // w), filled[r])]     # the last byte is filled up
        elif w > 8:
            codes = codes.view(f">u{w // 8}")
        x = values[np.repeat(np.cumsum(n[r]) - n[r], filled[r]) + codes]
        if c and unit:
            row = np.repeat(np.arange(len(r)), filled[r])
            x /= np.sqrt(np.bincount(row, x * x, len(r)))[row]
        entries[_ragged((np.cumsum(filled) - filled)[r], filled[r])] = x
    out[there] = entries
    return out
