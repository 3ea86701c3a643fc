"""Relevance evaluation: judgments, metrics per query, summaries and paired comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEPTH, MOST_GRADE, TRIALS, SMOKE_QUERIES, LOW_COVERAGE = 10, 3, 10_000, 20, 0.5


class JudgmentError(ValueError):
    pass


def parse_judgments(raw: str) -> list[tuple[str, str, int]]:
    """Lines 'query: words' open a query; '<grade> <url>' lines judge under it; # begins a comment.
    Errors: a judgment before any query, a bad grade, a missing address, one address twice, no judgment at all."""
    rows: list[tuple[str, str, int]] = []
    seen: set[tuple[str, str]] = set()
    query = None
    for no, line in enumerate(raw.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.lower().startswith("query:"):
            query = line[6:].strip()
            continue
        grade, _, url = line.partition(" ")
        url = url.strip()
        if query is None:
            raise JudgmentError(f"line {no}: a judgment before any query")
        if not grade.isdigit() or int(grade) > MOST_GRADE:
            raise JudgmentError(f"line {no}: grade {grade!r} is not 0 to {MOST_GRADE}")
        if not url:
            raise JudgmentError(f"line {no}: no address")
        if (query, url) in seen:
            raise JudgmentError(f"line {no}: {url} is judged twice")
        seen.add((query, url))
        rows.append((query, url, int(grade)))
    if not rows:
        raise JudgmentError("no judgments")
    return rows


def clean_judgments(judgments: DataFrame) -> DataFrame:
    """(query, url, grade): queries trimmed and lower-cased, null grades dropped, the higher of two grades."""
    q = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    return judgments.where("grade is not null and url is not null and query is not null").select(q.alias("query"), "url", "grade").groupBy("query", "url").agg(F.max("grade").alias("grade"))


def numbered_queries(judged: DataFrame) -> DataFrame:
    """(query_id, text): ids are hashes, so that no global order is needed."""
    return judged.select("query").distinct().select(F.xxhash64("query").alias("query_id"), F.col("query").alias("text"))


def metrics(ranked: DataFrame, judged: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per judged query. ranked: (query, rank, url, final_url); judged: (query, url, grade).

    A result is judged by its final address if that is judged, else by its address. Precision divides by the
    results returned; recall is 1 where nothing is relevant; nDCG is 1 where nothing can be gained."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    discount = lambda r: 1.0 / F.log2(r + 1)
    grades = judged.select("query", "url", "grade")
    top = ranked.where(F.col("rank") <= depth)
    by_final = grades.select("query", F.col("url").alias("final_url"), F.col("grade").alias("g_final"))
    graded = top.join(by_final, ["query", "final_url"], "left").join(grades.withColumnRenamed("grade", "g_url"), ["query", "url"], "left").select("query", "rank", F.coalesce("g_final", "g_url").alias("grade"))
    got = graded.groupBy("query").agg(
        F.count(F.lit(1)).alias("returned"),
        F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("found"),
        F.count("grade").alias("judged_returned"),
        F.sum(F.coalesce(gain(F.col("grade")) * discount(F.col("rank")), F.lit(0.0))).alias("dcg"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
    )
    best = grades.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "url")))
    ideal = best.groupBy("query").agg(F.sum(F.when(F.col("place") <= depth, gain(F.col("grade")) * discount(F.col("place"))).otherwise(0.0)).alias("ideal"), F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("relevant"))
    rows = ideal.join(got, "query", "left").fillna(0, ["returned", "found", "judged_returned", "dcg"])
    ratio = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty))
    return rows.select("query", "returned", ratio("dcg", "ideal", 1.0).alias("ndcg"), ratio("found", "returned", 0.0).alias("precision"), F.when(F.col("first").isNotNull(), 1.0 / F.col("first")).otherwise(0.0).alias("reciprocal_rank"), ratio("found", "relevant", 1.0).alias("recall"), ratio("judged_returned", "returned", 0.0).alias("coverage"))


MEASURES = ["ndcg", "precision", "reciprocal_rank", "recall", "coverage"]


def summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *(F.avg(m).alias(m) for m in MEASURES), F.sum(F.when(F.col("returned") == 0, 1).otherwise(0)).alias("empty_results"))


def paired(one: DataFrame, two: DataFrame, measure: str = "ndcg") -> DataFrame:
    """(query, difference) of two runs on the same queries."""
    a, b = one.select("query", F.col(measure).alias("a")), two.select("query", F.col(measure).alias("b"))
    return a.join(b, "query").select("query", (F.col("b") - F.col("a")).alias("difference"))


def signs(trials: int, n: int, seed: int) -> np.ndarray:
    """trials x n signs from an xorshift64* stream: +1 where the top bit is set. Trials are drawn one after another."""
    out = np.empty(trials * n, np.int8)
    x, mask = seed & (2**64 - 1) or 1, 2**64 - 1
    for i in range(trials * n):
        x ^= x >> 12
        x = (x ^ (x << 25)) & mask
        x ^= x >> 27
        out[i] = 1 if (x * 0x2545F4914F6CDD1D) & mask >> 63 << 63 else -1
    return out.reshape(trials, n)


def randomisation_test(differences: list[float], trials: int = TRIALS, seed: int = 0x9E3779B97F4A7C15) -> dict:
    """Two-sided paired randomisation test; p = (as extreme + 1) / (trials + 1)."""
    d = np.array(differences, float)
    mean = float(d.mean()) if len(d) else 0.0
    extreme = trials
    if len(d):
        sums = signs(trials, len(d), seed) @ d / len(d)
        extreme = int((np.abs(sums) >= abs(mean) - 1e-12).sum())
    out = {"queries": len(d), "mean_difference": mean, "better": int((d > 0).sum()), "worse": int((d < 0).sum()), "unchanged": int((d == 0).sum()), "p": (extreme + 1) / (trials + 1)}
    return out | {"verdict": verdict(out)}


def verdict(c: dict, level: float = 0.05) -> str:
    if c["queries"] < SMOKE_QUERIES:
        return f"{c['queries']} queries: a smoke test, no evidence"
    if c["p"] >= level:
        return f"no significant difference (p = {c['p']:.3f})"
    return f"significantly {'better' if c['mean_difference'] > 0 else 'worse'} (p = {c['p']:.3f})"


def compare(spark: SparkSession, one: DataFrame, two: DataFrame, measure: str = "ndcg") -> DataFrame:
    """One row of :func:`randomisation_test`. Judged queries are few (a person graded each), so their differences go to the driver."""
    found = randomisation_test([r.difference for r in paired(one, two, measure).orderBy("query").collect()])
    return spark.createDataFrame([tuple(found.values())], "queries bigint, mean_difference double, better bigint, worse bigint, unchanged bigint, p double, verdict string")


def notes(summary_row: dict, authority: bool = True) -> list[str]:
    out = [] if authority else ["no authority table: hosts are not weighed"]
    if summary_row["coverage"] is not None and summary_row["coverage"] < LOW_COVERAGE:
        out.append(f"only {summary_row['coverage']:.0%} of the results are judged: figures say little")
    return out
