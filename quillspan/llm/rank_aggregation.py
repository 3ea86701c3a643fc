"""One ranking from several differently-scaled scores: median rank aggregation.

Every item of a group is ranked in each score by the number of items with a strictly
greater value, so only orders count, never ranges. Items are ordered by the weighted
median of their ranks, then by the weighted mean, then by identifier.

Ranks are exact and need no task that holds a group: equal values are counted first,
each value falls into a bucket that keeps the order of doubles, bucket counts are
summed over each group, and only the values of one bucket are sorted together.

Defined results: null and NaN are no value: such an item is never greater than
another, and takes the place after all items with a value; rows that repeat a
(group, item) count once (the least of their values); null groups or items are left
out; a null, NaN or negative weight is zero, and if all are zero they count alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def order_bucket(v: Column, steps: int = 4096) -> Column:
    """A bigint that never falls as v rises: exponent and leading part of the fraction, so any scale is split alike."""
    size = F.abs(v)
    exponent = F.greatest(F.floor(F.log2(size)), F.lit(-1000))
    part = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * steps)
    code = (exponent + 1100) * (4 * steps) + F.greatest(part, F.lit(-steps)) + steps
    return F.when(size == float("inf"), F.lit(2**40) * F.signum(v)).when(v > 0, code).when(v < 0, -code).otherwise(F.lit(0)).cast("bigint")


def greater_counts(values: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """Adds ``greater``: of the summed counts of the same keys, those with a strictly greater value. One row per (keys, value)."""
    once = values.groupBy(*keys, value).agg(F.sum(count).alias("n")).withColumn("bucket", order_bucket(F.col(value)))
    k = ", ".join(keys)
    buckets = once.groupBy(*keys, "bucket").agg(F.sum("n").alias("in_bucket")).selectExpr(*keys, "bucket", f"sum(in_bucket) over (partition by {k} order by bucket desc) - in_bucket as above")
    inside = once.selectExpr(*keys, value, "n", "bucket", f"sum(n) over (partition by {k}, bucket order by {value} desc) - n as before")
    return inside.join(buckets, [*keys, "bucket"]).select(*keys, value, (F.col("above") + F.col("before")).alias("greater"))


def score_ranks(items: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """One row per (group, item): n (items of the group), and for each score s: s (null where it is no value),
    greater_s (items with a greater value; null without value) and rank_s (its place, that of items without a value last)."""
    clean = [F.min(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(s) for s in scores]
    once = materialise(items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*clean), "scores")
    sizes = once.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.count(s).alias(f"valued_{s}") for s in scores))
    # All scores go through one plan as rows (group, score, value), and come back side by side at its end.
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("score"), F.col(s).alias("v")) for i, s in enumerate(scores))))
    long = once.select(group, item, values.alias("x")).select(group, item, "x.score", "x.v").where("v is not null")
    counted = long.groupBy(group, "score", "v").agg(F.count(F.lit(1)).alias("c"))
    placed = long.join(greater_counts(counted, [group, "score"], "v", "c"), [group, "score", "v"])
    wide = placed.groupBy(group, item).agg(*(F.max(F.when(F.col("score") == i, F.col("greater"))).alias(f"greater_{s}") for i, s in enumerate(scores)))
    out = once.join(wide, [group, item], "left").join(sizes, group)
    return out.select(group, item, "n", *scores, *(f"greater_{s}" for s in scores), *(F.coalesce(F.col(f"greater_{s}") + 1, F.col(f"valued_{s}") + 1).alias(f"rank_{s}") for s in scores))


def weighted_median(pairs: Column) -> Column:
    """Lower weighted median of an array of struct<rank, weight>."""
    half = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["weight"]) / 2
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
    step = lambda s, x: F.struct((s["sum"] + x["weight"]).alias("sum"), F.when(s["at"].isNull() & (s["sum"] + x["weight"] >= half), x["rank"]).otherwise(s["at"]).alias("at"))
    return F.aggregate(F.array_sort(pairs), start, step, lambda s: s["at"])


def aggregate_ranks(ranks: DataFrame, group: str, item: str, scores: list[str], weights: dict[str, Column]) -> DataFrame:
    """Adds median_rank, mean_rank and position (1, 2, ... within each group) to the rows of :func:`score_ranks`."""
    given = [F.when((weights[s] > 0) & ~F.isnan(weights[s]), weights[s]).otherwise(F.lit(0.0)) for s in scores]
    total = reduce(lambda a, b: a + b, given)
    w = [F.when(total > 0, x).otherwise(F.lit(1.0)) for x in given]
    all_w = reduce(lambda a, b: a + b, w)
    pairs = F.filter(F.array(*(F.struct(F.col(f"rank_{s}").cast("double").alias("rank"), x.alias("weight")) for s, x in zip(scores, w))), lambda x: x["weight"] > 0)
    mean = reduce(lambda a, b: a + b, (F.col(f"rank_{s}") * x for s, x in zip(scores, w))) / all_w
    scored = ranks.withColumn("median_rank", weighted_median(pairs)).withColumn("mean_rank", F.round(mean, 6))
    coarse = F.floor(F.col(item) / 65536) if dict(ranks.dtypes)[item] in ("bigint", "int", "smallint", "tinyint") else F.lit(0)
    scored = scored.withColumn("b1", F.floor(F.col("median_rank") / 512)).withColumn("b2", coarse)
    tied = ["b1", "median_rank", "mean_rank", "b2"]
    sums = scored.groupBy(group, *tied).agg(F.count(F.lit(1)).alias("c"))
    inside = sums.selectExpr(group, *tied, f"sum(c) over (partition by {group}, b1 order by median_rank, mean_rank, b2) - c as inside")
    outside = sums.groupBy(group, "b1").agg(F.sum("c").alias("c")).selectExpr(group, "b1", f"sum(c) over (partition by {group} order by b1) - c as outside")
    last = scored.selectExpr("*", f"row_number() over (partition by {group}, {', '.join(tied)} order by {item}) as r")
    placed = last.join(inside, [group, *tied]).join(outside, [group, "b1"])
    return placed.withColumn("position", F.col("outside") + F.col("inside") + F.col("r")).drop("b1", "b2", "r", "inside", "outside")
