"""Long exact spans shared between records: relative Lempel-Ziv parsing against indexed reference blocks.

A character is shared if some ``length`` consecutive characters around it stand
verbatim in another record. The whole collection is the reference, cut into blocks:

* *Seeds.* Of the grams of ``gram`` characters, each window of ``length`` characters keeps
  its least (an anchor). Two equal windows keep the same anchor, so every place that a
  long factor could be copied from meets the record at that anchor: records are joined
  to all blocks that can hold a factor of theirs, and to no others.
* *Reference blocks.* A block is an anchor found in at least two records, with every
  distinct *context* (the characters that a window around the anchor can hold) once. Its
  index holds the hashes of all windows by their place about the anchor, and the contexts
  in the order of their characters from the anchor on, as a suffix array has them.
* *Parsing.* A context is parsed from left to right. The factor at a window is the longest
  match with any context of another record: its source is a neighbour of it in the
  suffix order among the contexts that share the window, so two comparisons by hashed
  extension find it. Shorter factors are skipped.
* *Boundaries.* A window that lies across the end of a factor is looked up in the index as
  well: the next factor begins at the first window whose longest match reaches further.
  So a context gives a staircase of overlapping factors, and no window is lost between
  two sources. At the reach of an anchor, the factor goes on at the next anchor.

Contexts that two records share whole need no parsing: they are factors from end to end.
A block of many distinct contexts (a hot anchor) is not gathered into one task: its index
is partitioned by window, and its windows are looked up there, with partial sums.

Defined results: null and short texts give no rows; rows that repeat an id count as
one record; null ids are left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import codepoints as cp

U = np.uint64
LENGTH, GRAM = 200, 80
#: Distinct contexts of one block that are factored in one task.
MOST_CONTEXTS = 5_000


def anchors(cps: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: text, place in the text, hash, hash of its context, characters of the context before and after the place."""
    pre = cp.prefix(cp.exact_symbols(cps))
    grams = cp.gram_hash(pre, gram)
    at = cp.winnow(grams, cp.gram_ends(offsets, len(grams), gram), length - gram + 1)
    text = np.searchsorted(offsets, at, "right") - 1
    left = np.minimum(at - offsets[text], length - gram)
    right = np.minimum(offsets[text + 1] - at, length)
    context = cp.span_hash(pre, at - left, at + right) ^ cp.mix((left * 4096 + right).astype(U))
    return text, at - offsets[text], grams[at], context, left, right


def _index(length: int, gram: int, combined: bool):
    """Anchors as rows; combined: one row per anchor and text pair of ids (least, greatest) within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, z in cp.slices(texts):
                cps, off = cp.code_points(texts.slice(a, z - a))
                text, pos, fp, ctx, left, right = anchors(cps, off, length, gram)
                own = ids.slice(a, z - a).to_numpy(zero_copy_only=False)[text] if len(text) else np.zeros(0, np.int64)
                if combined:
                    order = np.argsort(fp, kind="stable")
                    fp, own = fp[order], own[order]
                    head = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, np.int64)
                    low, high = (np.minimum.reduceat(own, head), np.maximum.reduceat(own, head)) if len(fp) else (own, own)
                    yield pa.RecordBatch.from_arrays([cp.signed(fp[head]), pa.array(low), pa.array(high)], names=["fp", "low", "high"])
                else:
                    yield pa.RecordBatch.from_arrays([cp.signed(fp), cp.signed(ctx), pa.array(own), pa.array(pos.astype(np.int32)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))], names=["fp", "ctx", "id", "pos", "before", "after"])

    return run


def _contexts(length: int, gram: int):
    """The characters of the wanted contexts. A context is cut out only where its hash agrees, so of
    several texts under one id the right one is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(0), batch.column(1)
            for a, z in cp.slices(texts):
                cps, off = cp.code_points(texts.slice(a, z - a))
                pre = cp.prefix(cp.exact_symbols(cps))
                rows = wanted.slice(a, z - a).to_pylist()
                flat = [(off[i], off[i + 1], p) for i, places in enumerate(rows) for p in places]
                first = np.array([o + p["pos"] - p["before"] for o, _, p in flat], np.int64)
                last = np.array([o + p["pos"] + p["after"] for o, _, p in flat], np.int64)
                inside = last <= np.array([e for _, e, _ in flat], np.int64)
                marks = np.array([p["before"] * 4096 + p["after"] for _, _, p in flat], U)
                same = np.zeros(len(flat), bool)
                same[inside] = (cp.span_hash(pre, first[inside], last[inside]) ^ cp.mix(marks[inside])).view(np.int64) == np.array([p["ctx"] for _, _, p in flat], np.int64)[inside]
                kept = np.flatnonzero(same)
                col = lambda k: pa.array([flat[i][2][k] for i in kept], pa.int64())
                cut = [cps[first[i] : last[i]].tobytes().decode("utf-32-le", "surrogatepass") for i in kept]
                yield pa.RecordBatch.from_arrays([col("fp"), col("ctx"), col("low"), col("high"), col("before"), pa.array(cut, pa.string())], names=["fp", "ctx", "low", "high", "before", "chars"])

    return run


def windows_of(chars: list[str], length: int) -> list[np.ndarray]:
    """Hashes of all windows of each context."""
    cps, off = cp.code_points(pa.array(chars, pa.string()))
    grams = cp.gram_hash(cp.prefix(cp.exact_symbols(cps)), length)
    return [grams[a : z - length + 1] for a, z in zip(off[:-1], off[1:])]


def extension(pre: np.ndarray, one: np.ndarray, other: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many characters from two places on agree, up to ``most``: bisection over hashes of spans."""
    low, high = np.zeros(len(one), np.int64), most.astype(np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = cp.span_hash(pre, one, one + mid) == cp.span_hash(pre, other, other + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def parse(blocks: np.ndarray, chars: list[str], before: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The greedy factors of the contexts of whole blocks: context, start, end (within the context), context of the source.

    low and high: least and greatest id of the records that hold a context. Contexts of
    several records are sources only, as they are shared from end to end."""
    n = len(chars)
    suffix = np.array(sorted(range(n), key=lambda i: (blocks[i], chars[i][before[i] :])), np.int64)
    cps, off = cp.code_points(pa.array([chars[i] for i in suffix], pa.string()))
    pre = cp.prefix(cp.exact_symbols(cps))
    block, lead, least, most = blocks[suffix], before[suffix].astype(np.int64), low[suffix], high[suffix]
    count = np.maximum(np.diff(off) - length + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(n), count)
    place = np.arange(first[-1]) - first[:-1][owner]
    # The index: windows that agree in block, place about the anchor and characters lie together, in suffix order.
    start = off[:-1][owner] + place
    key = cp.gram_hash(pre, length)[start] ^ cp.mix(block.view(U))[owner] ^ cp.mix((place - lead[owner] + 4096).astype(U))
    order = np.argsort(key, kind="stable")
    sorted_owner = owner[order]
    who = np.where(least == most, least, -1 - np.arange(n, dtype=np.int64))
    record = who[sorted_owner]
    m = len(order)
    at = np.arange(m)
    new_group = np.r_[True, key[order][1:] != key[order][:-1]] if m else np.zeros(0, bool)
    new_record = new_group.copy()
    new_record[1:] |= record[1:] != record[:-1]
    heads = np.flatnonzero(new_record)
    run = np.cumsum(new_record) - 1
    run_end = np.r_[heads[1:], m]
    # The nearest window on either side that another record holds.
    prior = np.where(new_group[heads], -1, heads - 1)[run] if m else at
    later = np.where((run_end < m) & ~new_group[np.minimum(run_end, m - 1)], run_end, -1)[run] if m else at
    reach, source = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    single = (least == most)[sorted_owner]
    for near in (prior, later):
        held = np.flatnonzero((near >= 0) & single)
        if not len(held):
            continue
        pair = np.stack([sorted_owner[held], sorted_owner[near[held]]])
        code, back = np.unique(pair[0] * n + pair[1], return_inverse=True)
        one, other = code // n, code % n
        agreed = extension(pre, off[one] + lead[one], off[other] + lead[other], np.minimum(off[one + 1] - off[one] - lead[one], off[other + 1] - off[other] - lead[other]))[back]
        better = agreed > reach[held]
        reach[held[better]], source[held[better]] = agreed[better], pair[1][better]
    flat_reach, flat_source = np.empty(m, np.int64), np.empty(m, np.int64)
    flat_reach[order], flat_source[order] = reach, source
    # A factor begins where the longest match reaches further than the one before.
    begins = flat_reach >= 0
    begins[1:] &= (owner[1:] != owner[:-1]) | (flat_reach[1:] != flat_reach[:-1])
    f = np.flatnonzero(begins)
    return suffix[owner[f]], place[f], flat_reach[f] + lead[owner[f]], suffix[flat_source[f]]


def _factors(length: int):
    """Rows (fp, ctx, low, high, before, chars), whole blocks together -> (fp, ctx, first, last) of their factors."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        fp, ctx, low, high, before = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        own, first, last, _ = parse(fp, [r[5] for r in rows], before, low, high, length)
        return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(ctx[own]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["fp", "ctx", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if size >= cp.SLICE and rows[-1][0] != row[0]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield done(rows)

    return run


def _exploded(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, ctx, low, high, _, chars in zip(*(batch.column(i).to_pylist() for i in range(6))):
                w = windows_of([chars], length)[0]
                n = len(w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, fp)), pa.array(np.full(n, ctx)), pa.array(np.full(n, low)), pa.array(np.full(n, high)), cp.signed(w), pa.array(np.arange(n, dtype=np.int32))], names=["fp", "ctx", "low", "high", "w", "k"])

    return run


def shared_spans(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(id, span_start, span_end): the maximal runs of shared characters, from 0, end exclusive."""
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(f"id is not null and length(text) >= {length}")
    blocks = texts.mapInArrow(_index(length, gram, True), "fp bigint, low bigint, high bigint").groupBy("fp").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("fp")
    places = materialise(texts.mapInArrow(_index(length, gram, False), "fp bigint, ctx bigint, id bigint, pos int, before smallint, after smallint").join(blocks, "fp"), "places")
    contexts = places.groupBy("fp", "ctx").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.struct("id", "pos", "before", "after")).alias("at"))
    contexts = materialise(contexts, "contexts")
    whole = contexts.where("low < high").select("fp", "ctx", F.lit(0).alias("first"), (F.col("at.before") + F.col("at.after")).cast("int").alias("last"))
    crowd = contexts.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("low = high")).alias("some")).where("n > 1 and some")
    crowd = materialise(crowd, "crowd")

    def block_contexts(chosen: DataFrame) -> DataFrame:
        """(fp, ctx, low, high, before, chars) of the blocks chosen; the characters are cut out of one record of each context."""
        place = F.struct("fp", "ctx", "low", "high", F.col("at.pos").alias("pos"), F.col("at.before").alias("before"), F.col("at.after").alias("after"))
        wanted = contexts.join(chosen.select("fp"), "fp", "left_semi").select(F.col("at.id").alias("id"), place.alias("p")).groupBy("id").agg(F.collect_list("p").alias("wanted"))
        return texts.join(wanted, "id").select("text", "wanted").mapInArrow(_contexts(length, gram), "fp bigint, ctx bigint, low bigint, high bigint, before bigint, chars string")

    few = block_contexts(crowd.where(F.col("n") <= most_contexts)).repartition("fp").sortWithinPartitions("fp")
    parts = whole.unionByName(few.mapInArrow(_factors(length), "fp bigint, ctx bigint, first int, last int"))
    hot = crowd.where(F.col("n") > most_contexts)
    if not hot.isEmpty():
        each = materialise(block_contexts(hot), "hot").mapInArrow(_exploded(length), "fp bigint, ctx bigint, low bigint, high bigint, w bigint, k int")
        shared = each.groupBy("fp", "w").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("fp", "w")
        parts = parts.unionByName(each.join(shared, ["fp", "w"]).select("fp", "ctx", F.col("k").alias("first"), (F.col("k") + F.lit(length)).alias("last")))
    factors = places.join(parts, ["fp", "ctx"]).select("id", (F.col("pos") - F.col("before") + F.col("first")).alias("s"), (F.col("pos") - F.col("before") + F.col("last")).alias("e")).distinct()
    return merged(factors)


def merged(spans: DataFrame) -> DataFrame:
    """(id, s, e) -> the maximal runs of covered characters; touching spans are one run."""
    w = "partition by id order by s, e"
    marked = spans.selectExpr("id", "s", "e", f"max(e) over ({w} rows between unbounded preceding and 1 preceding) as reach")
    numbered = marked.selectExpr("id", "s", "e", f"sum(case when reach is null or s > reach then 1 else 0 end) over ({w} rows between unbounded preceding and current row) as run")
    return numbered.groupBy("id", "run").agg(F.min("s").cast("bigint").alias("span_start"), F.max("e").cast("bigint").alias("span_end")).drop("run")
