"""Frequency of every distinct term: compressed bitmaps of record identifiers per term.

Vertical layout: for each term and each block of 65,536 record identifiers there is
one container, a sorted array of 16-bit offsets or, beyond 4,095 of them, a bitmap
of 8 KiB, with a counter of occurrences beside it. Map tasks build containers, tasks
of one (term, block) merge them by union, and the document frequency of a term is
the sum of its cardinalities. A hot term is spread over its blocks, and a map task
sends at most one container per (term, block), whatever the number of its rows.

Union makes repeated rows harmless for document frequencies; for occurrences,
:func:`distinct_tokens` removes them first.

Defined results: terms are composed (NFC), trimmed and lower-cased; null and empty
terms, terms over 40 UTF-8 bytes and all-digit terms over 12 digits are left out; null
record ids are left out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

RARE_RECORDS, COMMON_SHARE = 2, 0.3
#: Offsets in an array; so an array is always shorter than the 8,192 bytes of a bitmap.
ARRAY_MOST = 4095
#: (term, record) pairs that a map task holds before it sends containers.
HELD = 1_000_000
SCHEMA = "term string, block bigint, container binary, occurrences bigint"


def normal_term(term: str | None) -> str | None:
    if term is None:
        return None
    t = unicodedata.normalize("NFC", term).strip().lower()
    if not t or len(t.encode("utf-8", "surrogatepass")) > 40 or (len(t) > 12 and t.isdigit()):
        return None
    return t


def pack(groups: np.ndarray, lows: np.ndarray) -> pa.Array:
    """Containers from group starts and the sorted distinct offsets of all groups."""
    sizes = np.diff(np.append(groups, len(lows)))
    if not len(sizes) or sizes.max() <= ARRAY_MOST:
        offsets = np.append(groups, len(lows)).astype(np.int32) * 2
        return pa.Array.from_buffers(pa.binary(), len(groups), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(lows.astype("<u2"))])
    out = []
    for a, n in zip(groups, sizes):
        part = lows[a : a + n]
        if n > ARRAY_MOST:
            bits = np.zeros(65536, bool)
            bits[part] = True
            out.append(np.packbits(bits).tobytes())
        else:
            out.append(part.astype("<u2").tobytes())
    return pa.array(out, pa.binary())


def unpack(containers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and offset of every member of every container."""
    sizes = pc.binary_length(containers).to_numpy(zero_copy_only=False)
    if not (sizes == 8192).any():
        data = b"" if containers.buffers()[2] is None else containers.buffers()[2].to_pybytes()
        first = np.frombuffer(containers.buffers()[1], np.int32)[containers.offset] if len(containers) else 0
        return np.repeat(np.arange(len(containers)), sizes // 2), np.frombuffer(data, "<u2", sizes.sum() // 2, first).astype(np.int64)
    lows = [np.flatnonzero(np.unpackbits(np.frombuffer(c, np.uint8))) if len(c) == 8192 else np.frombuffer(c, "<u2").astype(np.int64) for c in containers.to_pylist()]
    return np.repeat(np.arange(len(lows)), [len(x) for x in lows]), np.concatenate(lows)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, id) rows -> containers. Code 0 stands for all records."""
    known: dict[str | None, int] = {}
    terms: list[str | None] = [None]
    codes: dict[str, int] = {}

    def code(raw: str | None) -> int:
        if raw not in known:
            t = normal_term(raw)
            if t is None:
                known[raw] = -1
            else:
                if t not in codes:
                    codes[t] = len(terms)
                    terms.append(t)
                known[raw] = codes[t]
        return known[raw]

    def reduced(c: np.ndarray, d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((d, c))
        c, d, n = c[order], d[order], n[order]
        head = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])]) if len(c) else np.zeros(0, np.int64)
        return c[head], d[head], np.add.reduceat(n, head) if len(head) else n

    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        c, d, n = reduced(*(np.concatenate(x) for x in zip(*held)))
        block = d >> 16
        head = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (block[1:] != block[:-1])]) if len(c) else np.zeros(0, np.int64)
        counts = np.add.reduceat(n, head) if len(head) else n
        for a in range(0, len(head), 20_000):
            z = min(a + 20_000, len(head))
            lo, hi = head[a], head[z] if z < len(head) else len(c)
            yield pa.RecordBatch.from_arrays([pa.array([terms[i] for i in c[head[a:z]]], pa.string()), pa.array(block[head[a:z]]), pack(head[a:z] - lo, d[lo:hi] & 0xFFFF), pa.array(counts[a:z])], names=["term", "block", "container", "occurrences"])

    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        words = batch.column(0).dictionary_encode()
        table = np.array([code(t) for t in words.dictionary.to_pylist()] + [-1], np.int64)
        index = words.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)
        c, d = table[index], batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        every = np.unique(d)
        keep = c >= 0
        part = reduced(np.concatenate([c[keep], np.zeros(len(every), np.int64)]), np.concatenate([d[keep], every]), np.concatenate([np.ones(keep.sum(), np.int64), np.zeros(len(every), np.int64)]))
        held.append(part)
        size += len(part[0])
        if size > HELD:
            yield from sent(held)
            held, size = [], 0
            if len(known) > HELD:
                known.clear()
                codes.clear()
                terms[1:] = []
    if held:
        yield from sent(held)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by (term, block) -> one per (term, block), with its cardinality."""

    def merged(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        term, block = t.column(0).combine_chunks(), t.column(1).to_numpy()
        code = term.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        head = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(block))))
        rows, lows = unpack(t.column(2).combine_chunks())
        both = np.unique((group[rows] << 16) | lows)
        g, low = both >> 16, both & 0xFFFF
        starts = np.searchsorted(g, np.arange(len(head)))
        size = np.diff(np.append(starts, len(g)))
        return pa.RecordBatch.from_arrays([term.take(pa.array(head)), pa.array(block[head]), pack(starts, low), pa.array(size), pa.array(np.add.reduceat(t.column(3).to_numpy(), head))], names=["term", "block", "container", "records", "occurrences"])

    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        n = now.num_rows
        if not n:
            continue
        code = now.column(0).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        block = now.column(1).to_numpy()
        # Where the last group begins; it may go on in the next batch.
        cut = int(n - 1 - np.argmin(np.r_[((code == code[-1]) & (block == block[-1]))[::-1], False])) + 1
        if cut:
            yield merged(now.slice(0, cut))
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield merged(rest)


def bitmaps(tokens: DataFrame, id_col: str, term_col: str) -> DataFrame:
    """(term, block, container, records, occurrences); the rows of a null term hold all records."""
    pairs = tokens.where(F.col(id_col).isNotNull()).select(F.col(term_col).cast("string").alias("term"), F.col(id_col).cast("bigint").alias("id"))
    built = pairs.mapInArrow(_build, SCHEMA)
    return built.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(_merge, "term string, block bigint, container binary, records bigint, occurrences bigint")


def distinct_tokens(tokens: DataFrame, keys: list[str], term_col: str) -> DataFrame:
    return tokens.groupBy(*keys).agg(F.min(term_col).alias(term_col))


def frequencies(tokens: DataFrame, id_col: str, term_col: str, rare_records: int = RARE_RECORDS, common_share: float = COMMON_SHARE) -> DataFrame:
    """(term, occurrences, records, mark): mark is 'rare', 'common' or null."""
    per_term = materialise(bitmaps(tokens, id_col, term_col).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")), "terms")
    total = per_term.where("term is null").agg(F.coalesce(F.max("records"), F.lit(0))).first()[0]
    mark = F.when(F.col("records") <= rare_records, F.lit("rare")).when(F.col("records") > F.lit(total) * F.lit(common_share), F.lit("common"))
    return per_term.where("term is not null").select("term", "occurrences", "records", mark.alias("mark"))
