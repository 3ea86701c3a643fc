"""The crawl store and small text sources.

Records are Parquet with a fixed schema and a format version; a store of another
version is refused. Seeds and judgments are small hand-written texts, parsed on the
driver with their errors named by line.
"""

from __future__ import annotations

import codecs
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import normalise
from ..operators.evaluate import parse_judgments

FORMAT_VERSION = 1
RECORD_SCHEMA = (
    "crawl_doc bigint, url string, final_url string, host string, fetched_at bigint, status int, depth int, fingerprint bigint, title string, text string, headings array<string>, lang string, "
    "links array<struct<url:string,anchor:string,nofollow:boolean>>, quality struct<text_ratio:double,link_density:double,scripts:int,words:int>, snippet_allowed boolean, max_snippet int"
)
PARSEABLE = ("text/html", "application/xhtml+xml", "text/plain", "")
MOST_BYTES, SNIFF = 4 << 20, 2048


class StoreError(ValueError):
    pass


def write_store(records: DataFrame, path: str) -> DataFrame:
    """Append records and rewrite the summary; returns the summary."""
    records.withColumn("format_version", F.lit(FORMAT_VERSION)).write.mode("append").option("compression", "zstd").parquet(f"{path}/records")
    made = summary(open_store(records.sparkSession, path))
    made.write.mode("overwrite").json(f"{path}/summary")
    return made


def open_store(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(RECORD_SCHEMA + ", format_version int").parquet(f"{path}/records")
    versions = [r[0] for r in df.select("format_version").distinct().limit(2).collect()]
    if any(v != FORMAT_VERSION for v in versions):
        raise StoreError(f"store format {versions}, expected {FORMAT_VERSION}")
    return df.drop("format_version")


def summary(records: DataFrame) -> DataFrame:
    """One row: pages, hosts, bytes of text, deepest page, first and last fetch, pages by status as a map."""
    by = records.groupBy("status").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("status"), F.lit(0)).alias("status"), "n")))).alias("m"))
    return records.agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"), F.sum(F.octet_length("text")).alias("text_bytes"), F.max("depth").alias("deepest"), F.min("fetched_at").alias("first_fetch"), F.max("fetched_at").alias("last_fetch")).withColumn("by_status", by.scalar())


def lookup(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of given (crawl_doc) rows."""
    return records.join(wanted.select("crawl_doc").distinct(), "crawl_doc", "left_semi")


def parse_seeds(raw: str) -> list[str]:
    seeds = []
    for no, line in enumerate(raw.splitlines(), 1):
        line = line.split("#")[0].strip()
        if not line:
            continue
        url = normalise(line)
        if url is None:
            raise StoreError(f"line {no}: {line!r} is no web address")
        seeds.append(url)
    if not seeds:
        raise StoreError("no seeds")
    return seeds


def judgments(spark: SparkSession, raw: str) -> DataFrame:
    return spark.createDataFrame(parse_judgments(raw), "query string, url string, grade int")


def parseable(content_type: Column) -> Column:
    return F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0])).isin(*PARSEABLE)


def charset(body: bytes, content_type: str | None) -> str:
    """By header, then by a meta tag near the start, else UTF-8."""
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I) or re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", body[:SNIFF].decode("latin-1"), re.I)
    try:
        return codecs.lookup(found.group(1)).name if found else "utf-8"
    except LookupError:
        return "utf-8"


def decode(body: bytes | None, content_type: str | None = None) -> str | None:
    if body is None:
        return None
    if body[:3] == codecs.BOM_UTF8:
        return body[3:].decode("utf-8", "replace")
    return body.decode(charset(body, content_type), "replace")


@F.pandas_udf(T.StringType())
def decoded(bodies: pd.Series, content_types: pd.Series) -> pd.Series:
    return pd.Series([decode(None if b is None else bytes(b)[:MOST_BYTES], t) for b, t in zip(bodies, content_types)])


def failure(status: Column, error: Column) -> Column:
    """Category of a fetch that gave no page, or null."""
    return F.when(error == "timeout", "timeout").when(error.isNotNull(), "network").when(status.between(300, 399), "redirect").when(status == 429, "rate limit").when(status.between(400, 499), "client error").when(status >= 500, "server error")


def transient(category: Column) -> Column:
    return F.coalesce(category.isin("timeout", "network", "rate limit", "server error"), F.lit(False))


# --- Survey of domains -----------------------------------------------------------------------


def probe_outcome(status: Column, body: Column, error: Column) -> Column:
    """What an automatic reader meets at an address."""
    challenge = body.rlike(r"(?i)captcha|verify you are human|checking your browser|enable javascript and cookies")
    return F.when(error.isNotNull(), "unreachable").when(status.isin(401, 403, 429), "refused").when(F.coalesce(challenge, F.lit(False)), "challenged").when(status.between(200, 299), "served").otherwise("error")


def survey(rows: DataFrame, area: str) -> DataFrame:
    """Per area: domains, shares served, refused, challenged, and median and mean words of served pages."""
    served = F.col("outcome") == "served"
    share = lambda o: F.round(100 * F.avg((F.col("outcome") == o).cast("double")), 4).alias(f"pct_{o}")
    return rows.groupBy(area).agg(F.count(F.lit(1)).alias("domains"), *(share(o) for o in ("served", "refused", "challenged", "unreachable")), F.percentile(F.when(served, F.col("words")), 0.5).alias("median_words"), F.round(F.avg(F.when(served, F.col("words"))), 4).alias("mean_words"))


def host_from(url: str) -> str | None:
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None
