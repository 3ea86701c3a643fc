"""Near duplicates by fingerprint: banded self-join, and keeping the first arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.simhash import BLOCKS, MOST_DISTANCE, block, distance
from ..session import materialise


def hamming_pairs(fps: DataFrame, most: int = MOST_DISTANCE) -> DataFrame:
    """(a, b, distance): pairs of different fingerprints a < b at most ``most`` bits apart. Eight blocks of eight bits
    find all up to 7 bits. Fingerprints are joined, not records, so copies meet once; callers bring records back.

    A single block of 8 bits has 256 values, so its groups grow with the collection; pairs of blocks (28 keys of
    16 bits) hold all pairs up to 6 bits apart and are 256 times as selective, and these are the keys joined on."""
    if most > BLOCKS - 2:
        raise ValueError(f"two of {BLOCKS} blocks agree only up to {BLOCKS - 2} bits")
    each = _keyed(fps)
    a, b = each.withColumnRenamed("fingerprint", "a"), each.withColumnRenamed("fingerprint", "b")
    met = a.join(b, ["k", "v"]).where(F.col("a") < F.col("b")).withColumn("distance", distance(F.col("a"), F.col("b"))).where(F.col("distance") <= most)
    return met.select("a", "b", "distance").distinct()


def _keyed(fps: DataFrame) -> DataFrame:
    """(k, v, fingerprint): the pairs of blocks of each fingerprint.

    Spark takes the exploded rows for as many as the fingerprints, 28 times too few, and would broadcast what the driver
    cannot hold; the hint lets no join of them be a broadcast."""
    one = fps.select("fingerprint").where("fingerprint is not null and fingerprint <> 0").distinct()
    keys = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    made = F.array(*(F.struct(F.lit(k).alias("k"), (block(F.col("fingerprint"), i) * 256 + block(F.col("fingerprint"), j)).alias("v")) for k, (i, j) in enumerate(keys)))
    return one.select("fingerprint", F.explode(made).alias("key")).select("key.k", "key.v", "fingerprint").hint("merge")


def near_any(fps: DataFrame, kept: DataFrame, most: int = MOST_DISTANCE) -> DataFrame:
    """(fingerprint): those of fps that are equal to one of kept or at most ``most`` bits from it."""
    if most > BLOCKS - 2:
        raise ValueError(f"two of {BLOCKS} blocks agree only up to {BLOCKS - 2} bits")
    met = _keyed(fps).join(_keyed(kept).withColumnRenamed("fingerprint", "old"), ["k", "v"])
    return met.where(distance(F.col("fingerprint"), F.col("old")) <= most).select("fingerprint").distinct()


def keep_first(docs: DataFrame, pairs: DataFrame, order: str = "crawl_doc") -> DataFrame:
    """(crawl_doc, kept): a page is dropped if it is near a page kept before it, in arrival order.

    The order-dependent choice is settled in rounds: a fingerprint is kept once all its earlier neighbours are
    dropped, and dropped once one of them is kept. Each round is a join over the undecided links only.

    The sets joined here may hold most fingerprints, while their files, from which Spark plans, can be a tenth of what a
    broadcast of them takes on the driver; so no join is a broadcast."""
    merged = lambda df: df.hint("merge")
    first = docs.where("fingerprint is not null and fingerprint <> 0").groupBy("fingerprint").agg(F.min(order).alias("at"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = lambda c: first.select(F.col("fingerprint").alias(c), F.col("at").alias(f"at_{c}"))
    earlier = both.join(merged(at("a")), "a").join(merged(at("b")), "b").where("at_b < at_a").select("a", "b")
    earlier = materialise(earlier, "earlier")
    dropped = None
    waiting = earlier
    while True:
        nodes = waiting.select("b").distinct().join(merged(waiting.select(F.col("a").alias("b")).distinct()), "b", "left_anti")
        gone = materialise(waiting.join(merged(nodes), "b", "left_semi").select("a").distinct(), "gone")
        if gone.isEmpty():
            break
        dropped = gone if dropped is None else dropped.union(gone)
        waiting = materialise(waiting.join(merged(gone), "a", "left_anti").join(merged(gone.select(F.col("a").alias("b"))), "b", "left_anti"), "waiting")
    near = dropped.distinct() if dropped is not None else earlier.select("a").limit(0)
    own = docs.select(F.col(order), "fingerprint").join(merged(first), "fingerprint", "left").join(merged(near.select(F.col("a").alias("fingerprint"), F.lit(True).alias("near"))), "fingerprint", "left")
    return own.select(order, (F.col("at").isNull() | (F.col("near").isNull() & (F.col("at") == F.col(order)))).alias("kept"))
