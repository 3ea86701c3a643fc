"""The queries pN_... over the test tables, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hosts import plain_host
from ..session import table
from . import leakage, near_duplicates, rank_aggregation, repeated_lines, residue, shared_spans, spam, term_bitmaps, tokenizer

CRAWL = near_duplicates.Settings(shingle=3, similarity=0.7, min_words=80)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = near_duplicates.NearDuplicates(table(spark, sf_dir, "records"), "crawl_doc", "text", CRAWL)
    return op.pairs().select(F.col("a").alias("crawl_doc_a"), F.col("b").alias("crawl_doc_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = near_duplicates.NearDuplicates(table(spark, sf_dir, "records"), "crawl_doc", "text", CRAWL)
    return op.classes().withColumnRenamed("id", "crawl_doc")


SCORES = ["text_relevance", "proximity", "quality", "trust"]


def _score_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "host_scores").groupBy(plain_host(F.col("host")).alias("h")).agg(F.max("trust").alias("trust"))
    hits = table(spark, sf_dir, "hits").select("query_id", "crawl_doc", "text_relevance", "proximity", F.col("quality.factor").alias("quality"), plain_host(F.col("host")).alias("h"))
    return rank_aggregation.score_ranks(hits.join(hosts, "h", "left"), "query_id", "crawl_doc", SCORES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _score_ranks(spark, sf_dir)
    for s in SCORES:
        ranks = ranks.where(F.col(f"greater_{s}") * 10 < F.col("n"))
    return ranks.select("query_id", "crawl_doc")


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit's place in its query, by the weights of the set 'standard'; text relevance weighs 1."""
    row = table(spark, sf_dir, "rank_weights").where("weight_set = 'standard'").agg(F.max("proximity"), F.max("quality"), F.max("authority")).first()
    weights = {s: F.lit(float(w) if w is not None else 0.0) for s, w in zip(SCORES, (1.0, *row))}
    ranked = rank_aggregation.aggregate_ranks(_score_ranks(spark, sf_dir), "query_id", "crawl_doc", SCORES, weights)
    return ranked.select("query_id", "crawl_doc", "position", "median_rank", "mean_rank")


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, sf_dir, "records"), "crawl_doc", plain_host(F.col("host")), "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_pages(table(spark, sf_dir, "records"), "crawl_doc", plain_host(F.col("host")), "text").withColumnRenamed("id", "crawl_doc")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors, density = F.transform("links", lambda x: x["anchor"]), F.col("quality.link_density")
    return spam.spam_pages(table(spark, sf_dir, "records"), "crawl_doc", plain_host(F.col("host")), "text", anchors, density).withColumnRenamed("id", "crawl_doc")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir).withColumnRenamed("id", "crawl_doc")


def p5_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tested wordings of each host: counts, log-likelihood ratio, significance, and by which path a wording counts as repeated."""
    tests = repeated_lines.tested_lines(table(spark, sf_dir, "records"), "crawl_doc", plain_host(F.col("host")), "text")
    path = repeated_lines.chosen_wordings(tests).select(F.col("source").alias("s"), F.col("h1").alias("x"), F.col("h2").alias("y"), "path")
    both = tests.join(path, F.col("source").eqNullSafe(F.col("s")) & (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y")), "left")
    return both.select(F.col("source").alias("host"), "n_in", "records_in", "n_out", "records_out", F.round("llr", 4).alias("llr"), "significant", "path")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without the repeated lines."""
    return repeated_lines.without_lines(table(spark, sf_dir, "records"), "crawl_doc", "text", _repeated(spark, sf_dir)).withColumnRenamed("id", "crawl_doc")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_bitmaps.frequencies(table(spark, sf_dir, "tokens"), "crawl_doc", "term").where("mark is not null").select("term", "mark")


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every term, beside what the index reported for it at most."""
    tokens = term_bitmaps.distinct_tokens(table(spark, sf_dir, "tokens"), ["crawl_doc", "field", "token_position"], "term")
    reported = table(spark, sf_dir, "term_scores").where("term is not null").groupBy("term").agg(F.max("doc_frequency").alias("reported"))
    return term_bitmaps.frequencies(tokens, "crawl_doc", "term").join(reported, "term", "left")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text after encoding and decoding; null texts come back empty."""
    ids = tokenizer.encode(table(spark, sf_dir, "documents"), "doc_id", "text")
    return tokenizer.decode(ids, "id", "ids").withColumnRenamed("id", "doc_id")


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token: id, and the characters of the text it covers, wholly or in part."""
    ids = tokenizer.encode(table(spark, sf_dir, "documents"), "doc_id", "text", offsets=True)
    flat = ids.select(F.col("id").alias("doc_id"), F.posexplode(F.arrays_zip("ids", "starts", "ends")).alias("token_no", "t"))
    return flat.select("doc_id", F.col("token_no").cast("bigint").alias("token_no"), F.col("t.ids").alias("token_id"), F.col("t.starts").alias("char_start"), F.col("t.ends").alias("char_end"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_portion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is shared elsewhere."""
    docs = table(spark, sf_dir, "documents")
    covered = p9_found(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sized = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"))
    return sized.join(covered, "doc_id", "left").select("doc_id", "chars", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
