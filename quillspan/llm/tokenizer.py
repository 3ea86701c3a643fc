"""Encoding of a corpus with a public byte-level BPE of the tokenizers library.

Byte-level BPE merges only within *pieces* (the pattern's matches), so the ids of a
text are the ids of its pieces in turn. Piece boundaries are array expressions over
all code points of an Arrow batch; every distinct piece is given to the tokenizers
library once per worker, with its character offsets; texts are then assembled by
gathering. The result equals ``Tokenizer.encode`` of each whole text.

Ids of null and empty texts: an empty list. Decoding maps each id to the characters
of the byte table, these back to bytes, and the bytes to text; bytes of a character
that ids split are held until the character is whole, and bytes that are no UTF-8
become U+FFFD. Texts holding the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"

# Code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
# The endings that the public pattern takes as pieces of their own.
ENDINGS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    t = cp.tables()
    out = np.full(cp.LAST + 1, OTHER, np.uint8)
    out[t["letter"]] = LETTER
    out[t["number"]] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def pieces(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces, in order. Texts are never joined across their ends."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cp.clipped(cps)]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    last = np.zeros(n, bool)
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    last[ends - 1] = True
    before = np.empty(n, np.uint8)
    before[0] = 255
    before[1:] = kind[:-1]
    before[first] = 255
    run = kind != before
    start = run.copy()
    # The last blank before other characters leaves its run; a plain space joins what follows.
    after = np.empty(n, np.uint8)
    after[-1] = 255
    after[:-1] = kind[1:]
    after[last] = 255
    lone = (kind == SPACE) & (after != SPACE) & (after != 255)
    start |= lone
    joined = np.zeros(n, bool)
    joined[1:] = (lone & (cps == 32))[:-1]
    start &= ~(joined & run) | first
    # Endings: an apostrophe that begins a piece, with the letters after it.
    quotes = np.flatnonzero((cps == 39) & start)
    if len(quotes):
        end_of = np.repeat(offsets[1:], np.diff(offsets))[quotes]
        taken = np.zeros(len(quotes), np.int64)
        for ending in ENDINGS:
            m = len(ending)
            ok = (taken == 0) & (quotes + m <= end_of)
            for j in range(1, m):
                ok &= cps[np.minimum(quotes + j, n - 1)] == ord(ending[j])
            taken[ok] = m
        q, m = quotes[taken > 0], taken[taken > 0]
        for j in (1, 2):
            start[(q + j)[m > j]] = False
        stop = q + m
        stop = stop[stop < n]
        start[stop] = True
    return np.flatnonzero(start)


class Encoder:
    """Piece cache around one tokenizer file; one per Python worker."""

    #: Distinct pieces kept; beyond it the cache starts anew, which costs time only.
    MOST = 1_000_000

    def __init__(self, path: str):
        # One task has one core; the library's threads would only contend for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.rank = np.zeros(0, np.int64)
        self.count = 0
        self.ids = np.zeros(0, np.int32)
        self.chars = np.zeros((0, 2), np.int32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = self.tok.encode_batch(texts, add_special_tokens=False)
        lengths = np.fromiter((len(e.ids) for e in found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter((i for e in found for i in e.ids), np.int32, lengths.sum())])
        spans = np.array([o for e in found for o in e.offsets], np.int32).reshape(-1, 2)
        self.chars = np.concatenate([self.chars, spans])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        known, rank = np.concatenate([self.known, keys]), np.concatenate([self.rank, self.count + np.arange(len(keys))])
        order = np.argsort(known)
        self.known, self.rank, self.count = known[order], rank[order], self.count + len(keys)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, where each text starts among them, and each id's (start, end) characters in its text."""
        cps, off = cp.code_points(col)
        begin = pieces(cps, off)
        end = np.append(begin[1:], len(cps)) if len(begin) else begin
        keys = cp.span_hash(cp.prefix(cp.exact_symbols(cps)), begin, end)
        unique, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if self.count > self.MOST:
            self.clear()
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        near = place < len(self.known)
        new[near] = self.known[place[near]] != unique[near]
        if new.any():
            whole = cps.tobytes().decode("utf-32-le")
            self._learn(unique[new], [whole[begin[i] : end[i]] for i in at[new]])
            place = np.searchsorted(self.known, unique)
        slot = self.rank[place][inverse.ravel()] if len(unique) else np.zeros(0, np.int64)
        lengths = self.starts[slot + 1] - self.starts[slot]
        total = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        source = np.repeat(self.starts[slot] - total[:-1], lengths) + np.arange(total[-1])
        text_starts = total[np.searchsorted(begin, off)]
        shift = begin - off[np.maximum(np.searchsorted(off, begin, "right") - 1, 0)]
        spans = self.chars[source] + np.repeat(shift, lengths)[:, None].astype(np.int32)
        return self.ids[source], text_starts, spans


def _local(path: str) -> str:
    """The vocabulary file as a worker finds it: at its path, or as it was sent."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def _sent(df: DataFrame, path: str) -> None:
    """Workers that do not see the driver's disk get the file with the job."""
    df.sparkSession.sparkContext.addFile(path)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_local(path))
        for batch in batches:
            key, texts = batch.column(0), batch.column(1)
            for a, z in cp.slices(texts):
                ids, starts, spans = enc.encode(texts.slice(a, z - a))
                rows = pa.array(starts.astype(np.int32))
                out = [key.slice(a, z - a), pa.ListArray.from_arrays(rows, pa.array(ids))]
                if offsets:
                    out += [pa.ListArray.from_arrays(rows, pa.array(spans[:, i])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "starts", "ends"][: len(out)])

    return run


def encode(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT_PATH, offsets: bool = False) -> DataFrame:
    """(id, ids[, starts, ends]): one row for every row of df, whatever its text."""
    _sent(df, path)
    schema = "id bigint, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encode(path, offsets), schema)


@cache
def byte_table() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def token_bytes(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    table, vocabulary = byte_table(), model["model"]["vocab"]
    out = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in model["added_tokens"])]))
    for token, i in vocabulary.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    for t in model["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [*token_bytes(_local(path)), b"\xff"]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        data = np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            rows = pa.concat_arrays([batch.column(1).fill_null([])])
            ids = rows.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = np.where((ids >= 0) & (ids < len(table) - 1), ids, len(table) - 1)
            # Bytes of all tokens one after another, gathered from one table; only whole texts are handled singly.
            size = bounds[known + 1] - bounds[known]
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = data[np.repeat(bounds[known] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
            cuts = ends[rows.offsets.to_numpy() - rows.offsets[0].as_py()]
            texts = [flat[x:y].decode("utf-8", "replace") for x, y in zip(cuts[:-1], cuts[1:])]
            nulls = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if gone else t for t, gone in zip(texts, nulls)], pa.string())], names=["id", "text"])

    return run


def decode(df: DataFrame, id_col: str, ids_col: str, path: str = DEFAULT_PATH) -> DataFrame:
    """(id, text). Null ids give null; an id outside the vocabulary gives U+FFFD."""
    _sent(df, path)
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(_decode(path), "id bigint, text string")
