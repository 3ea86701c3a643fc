"""Vectorised text kernels over Arrow columns.

A column of texts becomes one array of code points plus text offsets; words,
rolling hashes and window minima are then array expressions, so no kernel loops
over characters, words or rows in Python. Hashes are 64-bit polynomials over
mixed symbols, so they do not depend on where a text stands in its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Code points above this are outside every alphabet (CJK extension H is the last).
LAST = 0x33480
#: Characters handled at a time: arrays of this length stay near the processor.
SLICE = 400_000
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def tables() -> dict[str, np.ndarray]:
    """Per code point: letter, number, lower case."""
    letter, number = np.zeros(LAST + 1, bool), np.zeros(LAST + 1, bool)
    lower = np.arange(LAST + 1, dtype=np.uint32)
    for i in range(LAST):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if low != c:
                lower[i] = ord(low[0])
        elif c.isnumeric():
            number[i] = True
    return {"letter": letter, "number": number, "lower": lower, "hash": mix(np.arange(LAST + 1, dtype=U) + _BASE), "hash_lower": mix(lower.astype(U) + _BASE)}


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, U), np.full(n, _BASE_INVERSE, U)
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def slices(col: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes; one very long text is a range of its own."""
    lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > SLICE:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the column, and where each text starts (one more at the end). Null is empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint32), np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) == len(raw):
        return cps, off - off[0]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return cps, starts[off - off[0]]


def clipped(cps: np.ndarray) -> np.ndarray:
    return np.minimum(cps, LAST)


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span."""
    up, _ = powers(len(symbols))
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * up, out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for arrays of starts and ends."""
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def gram_hash(pre: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive symbols."""
    n = len(pre) - k
    if n <= 0:
        return np.zeros(0, U)
    _, down = powers(n)
    return mix((pre[k:] - pre[:n]) * down)


def word_bounds(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of letters and digits within one text), and the first word of each text."""
    t = tables()
    c = clipped(cps)
    inside = t["letter"][c] | t["number"][c]
    before = np.zeros(len(cps), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(cps), bool)
    after[:-1] = inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each lower-cased word, and the first word of each text."""
    start, end, first = word_bounds(cps, offsets)
    pre = prefix(tables()["hash_lower"][clipped(cps)])
    return span_hash(pre, start, end), start, end, first


def exact_symbols(cps: np.ndarray) -> np.ndarray:
    """A symbol per code point that keeps all code points apart."""
    return tables()["hash"][cps] if not len(cps) or cps.max() < LAST else mix(cps.astype(U) + _BASE)


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over every w consecutive values, by doubling: log2(w) passes."""
    if len(x) < w:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def winnow(hashes: np.ndarray, ends: np.ndarray, w: int) -> np.ndarray:
    """Positions of the grams that are the least of some w consecutive grams of one text.

    ends[i] is the end of the grams of the text of gram i, where a gram that is not
    whole within its text has ends[i] <= i. Any two texts that share w consecutive
    grams choose a gram in common there."""
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64)
    low = sliding(hashes, w)
    low = np.where(np.arange(len(low)) + w <= ends[: len(low)], low, U(0))
    padded = np.zeros(n + w - 1, U)
    padded[w - 1 : w - 1 + len(low)] = low
    return np.flatnonzero((sliding(padded, w, np.maximum) == hashes) & (hashes > 0) & (np.arange(n) < ends))


def gram_ends(offsets: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of n gram starts, the end of the gram starts of its text."""
    lengths = np.diff(offsets)
    return np.repeat(offsets[1:] - k + 1, lengths)[:n]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
