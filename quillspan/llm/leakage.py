"""Evaluation texts leaking into training text: winnowing.

Words become hashes; of the grams of ``gram`` words, every window of
``span - gram + 1`` consecutive grams keeps its least. So two texts that share
``span`` consecutive words share a kept gram at the same place in that span,
whatever surrounds it: no shared span of that length is missed. The kept grams of
both sides are joined; a hit fixes an alignment of both texts, along which the words are
compared to the ends: every run of ``span`` or more equal words counts.

Defined results: null, empty and short texts on either side match nothing; rows that
repeat an id count once; null ids are left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import codepoints as cp

SPAN, GRAM = 13, 6
#: Kept grams of the evaluation side up to which they are broadcast (24 bytes each);
#: a larger side is joined by shuffling both.
BROADCAST_ROWS = 500_000


def kept_grams(words: np.ndarray, first: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the kept grams."""
    grams = cp.gram_hash(cp.prefix(words), gram)
    at = cp.winnow(grams, cp.gram_ends(first, len(grams), gram), span - gram + 1)
    return grams[at], at


def _fingerprints(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, z in cp.slices(texts):
                cps, off = cp.code_points(texts.slice(a, z - a))
                words, _, _, first = cp.word_hashes(cps, off)
                hashes, at = kept_grams(words, first, span, gram)
                text = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a).take(pa.array(text)), cp.signed(hashes), pa.array((at - first[text]).astype(np.int32))], names=["id", "fp", "pos"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, z in cp.slices(texts):
            cps, off = cp.code_points(texts.slice(a, z - a))
            words, _, _, first = cp.word_hashes(cps, off)
            yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array([words[first[i] : first[i + 1]].tobytes() for i in range(z - a)], pa.binary())], names=["id", "words"])


def shared_runs(x: np.ndarray, y: np.ndarray, diagonal: int, span: int) -> list[tuple[int, int]]:
    """First word in x and number of words of each maximal run of at least ``span`` equal words x[i], y[i - diagonal]."""
    start, end = max(0, diagonal), min(len(x), len(y) + diagonal)
    if end - start < span:
        return []
    same = x[start:end] == y[start - diagonal : end - diagonal]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]]))).reshape(-1, 2)
    return [(int(start + a), int(z - a)) for a, z in edge if z - a >= span]


def _extended(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, item, diagonals, dw, iw in zip(*(batch.column(c).to_pylist() for c in range(5))):
                x, y = np.frombuffer(dw, np.uint64), np.frombuffer(iw, np.uint64)
                for d in diagonals:
                    for first, n in shared_runs(x, y, d, span):
                        for o, v in zip(out, (doc, item, first, n)):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["doc_id", "item_id", "first_word", "words"])

    return run


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, span: int = SPAN, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, first_word, words): the maximal shared runs of at least ``span`` words."""
    pick = lambda df, i, t: df.select(F.col(i).cast("bigint").alias("id"), F.col(t).alias("text")).where("id is not null and text is not null")
    corpus, tests = pick(docs, doc_id, doc_text), pick(items, item_id, item_text)
    schema = "id bigint, fp bigint, pos int"
    ours = materialise(tests.mapInArrow(_fingerprints(span, gram), schema).distinct(), "items")
    theirs = corpus.mapInArrow(_fingerprints(span, gram), schema)
    item_side = ours.select(F.col("id").alias("item_id"), "fp", F.col("pos").alias("item_pos"))
    if ours.count() <= broadcast_rows:
        item_side = F.broadcast(item_side)
    # All runs of one alignment of two texts come out of comparing them along it once, so hits go on as their diagonals,
    # and the words of both texts are attached once per pair of texts.
    hits = theirs.join(item_side, "fp").select(F.col("id").alias("doc_id"), "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    hits = materialise(hits.groupBy("doc_id", "item_id").agg(F.collect_list("diagonal").alias("diagonals")), "hits")
    doc_words = corpus.join(hits.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").mapInArrow(_words, "id bigint, words binary").select(F.col("id").alias("doc_id"), F.col("words").alias("doc_words"))
    item_words = tests.mapInArrow(_words, "id bigint, words binary").select(F.col("id").alias("item_id"), F.col("words").alias("item_words"))
    both = hits.join(doc_words, "doc_id").join(item_words, "item_id").select("doc_id", "item_id", "diagonals", "doc_words", "item_words")
    return both.mapInArrow(_extended(span), "doc_id bigint, item_id bigint, first_word bigint, words bigint").distinct()
