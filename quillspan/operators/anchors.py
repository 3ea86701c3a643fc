"""Anchor texts of links from other sites, gathered for the page they point at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tidy
from ..functions.urls import host_node, site_udf

MAX_PHRASES, MAX_PHRASE_CHARS, MAX_TOTAL_BYTES = 12, 80, 400


def with_sites(df: DataFrame, hosts: list[str]) -> DataFrame:
    """Adds site_<host> for each host column. The site of each distinct host is worked out once."""
    every = df.select(F.explode(F.array(*hosts)).alias("host")).where("host is not null").distinct()
    sites = every.withColumn("site", site_udf()("host"))
    for h in hosts:
        df = df.join(sites.select(F.col("host").alias(h), F.col("site").alias(f"site_{h}")), h, "left")
    return df


def classified_links(docs: DataFrame) -> DataFrame:
    """One row per link, in crawl order: (crawl_doc, link_no, url, source_site, phrase, outcome).
    outcome is nofollow, uncrawled, same_site, blank, too_long or candidate."""
    known = docs.select(F.explode(F.array_distinct(F.array("url", "final_url"))).alias("url")).where("url is not null").distinct().withColumn("crawled", F.lit(True))
    links = docs.select("crawl_doc", host_node(F.col("final_url")).alias("source"), F.posexplode("links").alias("link_no", "link")).where("source is not null and source <> ''")
    flat = links.select("crawl_doc", "link_no", "source", F.col("link.url").alias("url"), F.col("link.anchor").alias("anchor"), F.coalesce("link.nofollow", F.lit(False)).alias("nofollow"))
    flat = with_sites(flat.withColumn("target", host_node(F.col("url"))), ["source", "target"]).join(known, "url", "left")
    phrase = tidy(F.col("anchor"))
    outcome = F.when(F.col("nofollow"), "nofollow").when(F.col("crawled").isNull(), "uncrawled").when(F.col("site_source") == F.col("site_target"), "same_site").when(phrase == "", "blank").when(F.length(phrase) > MAX_PHRASE_CHARS, "too_long").otherwise("candidate")
    return flat.select("crawl_doc", "link_no", "url", F.col("site_source").alias("source_site"), phrase.alias("phrase"), outcome.alias("outcome"))


def accepted_phrases(links: DataFrame) -> DataFrame:
    """(url, phrase): of each target, the distinct phrases of its first arrivals. A phrase counts once per site;
    a target is full once it has MAX_PHRASES different phrases."""
    first = links.where("outcome = 'candidate'").groupBy("url", "phrase").agg(F.min(F.struct("crawl_doc", "link_no")).alias("arrival"))
    w = Window.partitionBy("url").orderBy("arrival")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MAX_PHRASES).select("url", "phrase")


def packed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, anchor): phrases in order, joined by blanks, up to the first that would pass the limit of bytes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    sized = df.withColumn("n", F.row_number().over(w)).withColumn("reach", F.sum(F.octet_length("phrase") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # What is packed so far, the phrase and one byte more must fit.
    fits = F.when(F.col("n") == 1, F.col("reach")).otherwise(F.col("reach") - 1) <= MAX_TOTAL_BYTES
    stopped = sized.withColumn("stop", F.min(F.when(~fits, F.col("n"))).over(Window.partitionBy(*keys)))
    kept = stopped.where(F.col("stop").isNull() | (F.col("n") < F.col("stop")))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "phrase"))), lambda x: x["phrase"]), " ").alias("anchor"))


def anchor_texts(docs: DataFrame) -> DataFrame:
    """(crawl_doc, anchor): by the address asked for, then by the one arrived at."""
    phrases = accepted_phrases(classified_links(docs))
    keys = docs.select("crawl_doc", F.explode(F.when(F.col("url") == F.col("final_url"), F.array(F.struct(F.lit(0).alias("turn"), F.col("url").alias("url")))).otherwise(F.array(F.struct(F.lit(0).alias("turn"), F.col("url").alias("url")), F.struct(F.lit(1).alias("turn"), F.col("final_url").alias("url"))))).alias("k")).select("crawl_doc", "k.turn", "k.url").where("url is not null")
    return packed(keys.join(phrases, "url"), ["crawl_doc"], ["turn", "phrase"])


def anchor_report(docs: DataFrame) -> DataFrame:
    """(outcome, links): where the links went; repeated ones are candidates whose site said the phrase before."""
    links = classified_links(docs)
    w = Window.partitionBy("url", "source_site", "phrase").orderBy("crawl_doc", "link_no")
    again = F.when((F.col("outcome") == "candidate") & (F.row_number().over(w) > 1), "repeated").otherwise(F.col("outcome"))
    return links.withColumn("outcome", again).groupBy("outcome").agg(F.count(F.lit(1)).alias("links"))
