"""Near-duplicate records: universal hash minima, banding, verification, components.

1. Every text with enough words becomes ``bands * rows`` universal hash minima of
   its word shingles; each band of minima is one key. Texts of the same word
   sequence are one *class* and go on as one representative.
2. Representatives that share a band key are candidates. A crowded key is cut into
   blocks and every pair of blocks is its own group, so no task holds a whole key.
3. Candidates are verified by the signatures (estimated similarity) and then by
   the exact similarity of the shingle sets.
4. :func:`components` groups the verified links by alternating large-star and
   small-star rounds.

Defined results: null and short texts give no rows; rows that repeat an id count
once; a null id is left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialised, materialise
from . import codepoints as cp

U = np.uint64


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    min_words: int = 5
    #: 32 bands of 4 minima find a pair of similarity 0.7 with probability 0.9998.
    bands: int = 32
    rows: int = 4
    #: A candidate whose signatures agree in fewer than this share below the threshold goes no further (over 5 standard deviations of the estimate).
    slack: float = 0.22
    #: Members of one key that meet in one group; larger keys are cut into blocks.
    block: int = 64
    seed: int = 7


def _functions(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(s.seed)
    n = s.bands * s.rows
    return r.integers(0, 2**64, n, dtype=U), r.integers(0, 2**64, n, dtype=U)


def shingles(cps: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of the texts of enough words; where each of these texts starts;
    which texts they are; two hashes of the word sequence of each."""
    words, _, _, first = cp.word_hashes(cps, offsets)
    counts = np.diff(first)
    kept = np.flatnonzero(counts >= max(s.min_words, s.shingle))
    pre = cp.prefix(words)
    grams = cp.gram_hash(pre, s.shingle)
    n = counts[kept] - s.shingle + 1
    starts = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(n, out=starts[1:])
    at = np.repeat(first[kept] - starts[:-1], n) + np.arange(starts[-1])
    one = cp.span_hash(pre, first[kept], first[kept] + counts[kept])
    two = cp.span_hash(cp.prefix(cp.mix(words ^ U(0x5851F42D4C957F2D))), first[kept], first[kept] + counts[kept])
    return grams[at], starts, kept, np.stack([one, two])


def signatures(grams: np.ndarray, starts: np.ndarray, s: Settings) -> np.ndarray:
    """texts x (bands * rows) minima of x -> (a x + b mod 2^64) div 2^32, a strongly universal family for
    x of 32 bits (multiply-add-shift). The shift keeps order, so it follows the minimum."""
    a, b = _functions(s)
    x = grams >> U(32)
    out = np.empty((len(starts) - 1, len(a)), np.uint32)
    if len(out):
        v = np.empty_like(x)
        for j in range(len(a)):
            np.multiply(x, a[j], out=v)
            v += b[j]
            out[:, j] = np.minimum.reduceat(v, starts[:-1]) >> U(32)
    return out


def band_keys(sig: np.ndarray, s: Settings) -> np.ndarray:
    r = np.random.default_rng(s.seed + 1)
    weights = r.integers(0, 2**63, (s.bands, s.rows), dtype=np.uint64) | U(1)
    salt = cp.mix(np.arange(s.bands, dtype=U) + U(11))
    parts = sig.reshape(len(sig), s.bands, s.rows).astype(U) + U(1)
    return cp.mix((cp.mix(parts) * weights).sum(axis=2) + salt)


def _sketch(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, z in cp.slices(texts):
                cps, off = cp.code_points(texts.slice(a, z - a))
                grams, starts, kept, same = shingles(cps, off, s)
                if not len(kept):
                    continue
                keys = band_keys(signatures(grams, starts, s), s).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * s.bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a).take(pa.array(kept)), cp.signed(same[0]), cp.signed(same[1]), lists], names=["id", "c1", "c2", "bands"])

    return run


def _sets(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, z in cp.slices(texts):
                cps, off = cp.code_points(texts.slice(a, z - a))
                grams, starts, kept, _ = shingles(cps, off, s)
                # A byte of each minimum is enough to estimate by; nearly all candidates pass, so the sets come along.
                sig = signatures(grams, starts, s).astype(np.uint8)
                sets = [np.unique(grams[starts[i] : starts[i + 1]]).tobytes() for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a).take(pa.array(kept)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(sets, pa.binary())], names=["id", "sig", "grams"])

    return run


def _verified(s: Settings):
    least = s.similarity - s.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sim = [], [], []
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for ia, ib, sa, sb, ga, gb in zip(*cols):
                if (np.frombuffer(sa, np.uint8) == np.frombuffer(sb, np.uint8)).mean() < least:
                    continue
                x, y = np.frombuffer(ga, U), np.frombuffer(gb, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= s.similarity * (len(x) + len(y) - both):
                    a.append(ia)
                    b.append(ib)
                    sim.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    return run


def candidate_pairs(keyed: DataFrame, block: int) -> DataFrame:
    """Distinct pairs a < b of ids that share a key. keyed: (key, id), distinct ids of one key."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = keyed.join(sizes, "key").withColumn("g", F.ceil(F.col("n") / F.lit(float(block))).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("g").cast("bigint")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", "id", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    left, right = met.select("key", "x", "y", F.col("id").alias("a"), F.col("mine").alias("ma")), met.select("key", "x", "y", F.col("id").alias("b"), F.col("mine").alias("mb"))
    return left.join(right, ["key", "x", "y"]).where((F.col("a") < F.col("b")) & ((F.col("x") == F.col("y")) | (F.col("ma") != F.col("mb")))).select("a", "b").distinct()


class NearDuplicates:
    """The operator over (id, text); ``links`` and ``members`` are what both results use."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, settings: Settings | None = None):
        self.s = settings or Settings()
        self.texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
        sketch = self.texts.mapInArrow(_sketch(self.s), "id bigint, c1 bigint, c2 bigint, bands array<bigint>")
        self.sketch = materialise(sketch, "sketch")
        self.reps = self.sketch.groupBy("c1", "c2").agg(F.min("id").alias("rep"))

    @property
    def members(self) -> DataFrame:
        """(id, rep): each record with the representative of its class of equal word sequences."""
        return self.sketch.select("id", "c1", "c2").distinct().join(self.reps, ["c1", "c2"]).select("id", "rep").distinct()

    @property
    def links(self) -> DataFrame:
        """(a, b, similarity): verified pairs a < b of representatives."""
        s = self.s
        one = self.sketch.join(self.reps.select("rep"), self.sketch.id == F.col("rep"), "left_semi")
        keyed = one.select("id", F.explode("bands").alias("key")).select("key", "id").distinct()
        pairs = materialise(candidate_pairs(keyed, s.block), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = self.texts.join(ids, "id", "left_semi").mapInArrow(_sets(s), "id bigint, sig binary, grams binary").dropDuplicates(["id"])
        x, y = (sets.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("grams").alias(f"grams_{c}")) for c in "ab")
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "sig_a", "sig_b", "grams_a", "grams_b")
        return both.mapInArrow(_verified(s), "a bigint, b bigint, similarity double")

    def pairs(self) -> DataFrame:
        """(a, b): all pairs of records a < b that are near duplicates, copies included."""
        members = self.members
        links = self.links.select("a", "b").union(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
        x, y = (members.select(F.col("rep").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
        out = links.join(x, "a").join(y, "b").where("id_a <> id_b")
        return out.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()

    def classes(self) -> DataFrame:
        """(id, class_id, links): one row per record; class_id is the least id of its component."""
        links = materialise(self.links.select("a", "b"), "links")
        found = components(links)
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        grouped = self.members.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").join(degree, "rep", "left")
        return grouped.select("id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of the component of each node that has an edge.

    Alternates large-star and small-star until a pair of rounds changes nothing:
    about log^2 of the component's size. Each round is two aggregations whose
    partial sums hold only a minimum per node, so a hub of any degree is safe."""
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "star")
    before = None
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, now = now, materialise(small, "star")
        drop_materialised(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).distinct()
