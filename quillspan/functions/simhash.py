"""64-bit similarity fingerprints of texts and their distances."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE, BLOCKS, BLOCK_BITS, MOST_DISTANCE = 3, 8, 8, 6
# The public constants of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
_WORD = re.compile(r"[^\W_]+")


def fnv1a(texts: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once: one pass over byte places, not over strings."""
    n = np.array([len(t) for t in texts], np.int64)
    out = np.full(len(texts), FNV_OFFSET, np.uint64)
    if not len(texts):
        return out
    order = np.argsort(-n, kind="stable")
    flat, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(n) - n
    n, starts = n[order], starts[order]
    state = out.copy()
    for i in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -i, "left"))
        state[:live] = (state[:live] ^ flat[starts[:live] + i].astype(np.uint64)) * FNV_PRIME
    out[order] = state
    return out


def fingerprint(text: str | None) -> int:
    """Bit b is set if more shingles of three words hash to a 1 than to a 0 there. No words: 0."""
    words = [w.lower() for w in _WORD.findall(text or "")]
    if not words:
        return 0
    grams = [" ".join(words[i : i + SHINGLE]).encode() for i in range(max(1, len(words) - SHINGLE + 1))]
    hashes = fnv1a(grams)
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(grams)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint).astype("int64")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
