"""The crawl as rounds over tables: admit, fetch, keep, follow.

A round takes candidates, refuses those seen before, blocked, trapped or beyond their
host's quota, gives each host its turns, reads the pages from a fetcher, keeps those
that are no copies and hands on their links.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.robots import allowed, delays, verdict
from ..functions.simhash import MOST_DISTANCE, fingerprints
from ..functions.text import not_blank
from ..functions.urls import MAX_DEPTH, MAX_PER_HOST, dedupe_key, host_node, normal_url, path_of, trap
from ..session import materialise
from . import dedupe


@dataclass(frozen=True)
class Settings:
    """None is no bound. A host's addresses beyond per_host_and_round wait for a later round."""

    max_pages: int | None = 1000
    max_depth: int = MAX_DEPTH
    max_per_host: int | None = MAX_PER_HOST
    delay: float = 3.0
    per_host_and_round: int | None = 100
    blocked: tuple[str, ...] = ()
    #: Bits by which the fingerprint of a near copy differs at most; 0 drops exact copies only.
    near_bits: int = MOST_DISTANCE


def judged(candidates: DataFrame, fetched: DataFrame | None = None, seen: DataFrame | None = None, blocked: tuple[str, ...] = (), max_depth: int = MAX_DEPTH, max_per_host: int | None = MAX_PER_HOST) -> DataFrame:
    """Adds key, host, of_host and refusal to (url, depth, arrival): null where a candidate is admitted. In this order:
    inadmissible address, seen key or later twin of this round, blocked host, trap. of_host counts what fetched holds."""
    rows = candidates.withColumn("normal", normal_url(F.col("url")))
    rows = rows.withColumn("key", dedupe_key(F.col("normal"))).withColumn("host", host_node(F.col("normal")))
    known = seen.select("key").distinct().withColumn("was_seen", F.lit(True)) if seen is not None else None
    rows = rows.join(known, "key", "left") if known is not None else rows.withColumn("was_seen", F.lit(None).cast("boolean"))
    counts = fetched.groupBy("host").agg(F.count(F.lit(1)).alias("of_host")) if fetched is not None else None
    rows = rows.join(counts, "host", "left") if counts is not None else rows.withColumn("of_host", F.lit(0))
    twin = F.row_number().over(Window.partitionBy("key").orderBy("arrival"))
    refusal = F.when(F.col("normal").isNull(), "inadmissible").when(F.col("was_seen") | (F.col("twin") > 1), "seen").when(F.col("host").isin(list(blocked)) if blocked else F.lit(False), "blocked").otherwise(trap(F.col("normal"), F.col("depth"), F.coalesce("of_host", F.lit(0)), max_depth, max_per_host))
    return rows.withColumn("twin", twin).withColumn("refusal", refusal).withColumn("of_host", F.coalesce("of_host", F.lit(0))).drop("was_seen", "twin")


def within_quota(rows: DataFrame, max_per_host: int | None) -> DataFrame:
    """Refuses what :func:`judged` admitted of a host beyond its quota, later arrivals first."""
    if max_per_host is None:
        return rows
    place = F.row_number().over(Window.partitionBy("host", F.col("refusal").isNull()).orderBy("arrival"))
    over = F.col("refusal").isNull() & (F.col("of_host") + F.col("place") > max_per_host)
    return rows.withColumn("place", place).withColumn("refusal", F.when(over, "host quota").otherwise(F.col("refusal"))).drop("place")


def obeying(rows: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Refuses what robots.txt of the host forbids, and adds wait, the seconds it asks to keep between requests. robots: (host,
    status, body), one answer per host; a host without one is open, one that did not answer properly is closed."""
    known = robots.groupBy(host_node(F.concat(F.lit("http://"), F.col("host"))).alias("host")).agg(F.min(F.struct("status", "body")).alias("answer"))
    means, body = verdict(F.col("answer.status")), F.col("answer.body")
    rules = F.when(means == "rules", F.coalesce(body, F.lit("")))
    met = rows.join(known, "host", "left").withColumn("means", F.when(F.col("answer").isNotNull(), means)).withColumn("rules", rules)
    met = met.withColumn("free", allowed(agent)("rules", path_of(F.col("normal")))).withColumn("wait", delays(agent)("rules"))
    forbidden = F.col("refusal").isNull() & ((F.coalesce("means", F.lit("open")) == "closed") | ~F.col("free"))
    return met.withColumn("refusal", F.when(forbidden, "robots").otherwise(F.col("refusal"))).drop("answer", "means", "rules", "free")


def refusals(rows: DataFrame) -> DataFrame:
    return rows.where("refusal is not null").groupBy("refusal").agg(F.count(F.lit(1)).alias("candidates"))


def schedule(admitted: DataFrame, delay: float | Column) -> DataFrame:
    """Adds turn and ready: a host's n-th address waits n - 1 delays, in order of arrival."""
    turn = F.row_number().over(Window.partitionBy("host").orderBy("arrival"))
    return admitted.withColumn("turn", turn).withColumn("ready", (F.col("turn") - 1) * (F.lit(delay) if isinstance(delay, (int, float)) else delay))


def storable(pages: DataFrame) -> Column:
    """Neither noindex nor noarchive, and some text."""
    return F.col("directives.index") & F.col("directives.archive") & not_blank(F.col("text"))


def followed(pages: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth, arrival): links to follow of pages that allow it, in the order in which the pages were read (at)."""
    links = pages.where("directives.follow").select("url", "depth", "at", F.posexplode("links").alias("no", "link")).where(~F.col("link.nofollow"))
    return links.select(F.col("link.url").alias("url"), (F.col("depth") + 1).alias("depth"), F.concat_ws(" ", "at", F.col("url"), F.lpad(F.col("no").cast("string"), 6, "0")).alias("arrival")).where(F.col("depth") <= max_depth)


def first_kept(pages: DataFrame, stored: DataFrame | None, near_bits: int = MOST_DISTANCE) -> DataFrame:
    """(arrival): the pages near no page stored before, nor near a page of their own round that is kept and arrived earlier."""
    new = pages.select("arrival", "fingerprint")
    if stored is not None:
        new = materialise(new.join(dedupe.near_any(new, stored, near_bits), "fingerprint", "left_anti"), "unlike")
    return materialise(dedupe.keep_first(new, dedupe.hamming_pairs(new, near_bits), "arrival").where("kept").select("arrival"), "kept")


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], settings: Settings = Settings(), robots: DataFrame | None = None, agent: str = "quillspan") -> tuple[DataFrame, DataFrame]:
    """(records, refused). robots: see :func:`obeying`. ``fetch`` takes (url, depth, host, key, ready) and returns pages (url, depth, host, key, title,
    text, headings, links, directives ...); where a page failed or is robbed of access it gives no row. ready is the second
    of the crawl before which the address must not be read. Rounds end when no address waits, or once max_pages are stored:
    the first by arrival. Exact copies and near copies are kept once, by first arrival; their links are followed."""
    todo = seeds.select("url", F.lit(0).alias("depth"), F.col("url").alias("arrival"))
    seen = waiting = stored = refused = None
    n_stored, n_round, start = 0, 0, 0.0
    while True:
        rows = judged(todo, seen, seen, settings.blocked, settings.max_depth, settings.max_per_host)
        rows = obeying(rows, robots, agent) if robots is not None else rows.withColumn("wait", F.lit(0.0))
        rows = materialise(within_quota(rows, settings.max_per_host), "round")
        bad = rows.where("refusal is not null").select("url", "refusal")
        refused = bad if refused is None else refused.union(bad)
        new = rows.where("refusal is null").select(F.col("normal").alias("url"), "depth", "host", "key", "wait", F.concat_ws(" ", F.lit(f"{n_round:06d}"), "arrival").alias("arrival"))
        seen = new.select("key", "host") if seen is None else seen.union(new.select("key", "host"))
        queue = materialise(schedule(new if waiting is None else waiting.unionByName(new), F.greatest(F.lit(settings.delay), F.col("wait"))), "queue")
        now = queue if settings.per_host_and_round is None else queue.where(F.col("turn") <= settings.per_host_and_round)
        last = now.agg(F.max("ready")).first()[0]
        if last is None:
            break
        waiting = None if settings.per_host_and_round is None else queue.where(F.col("turn") > settings.per_host_and_round).drop("turn", "ready")
        now = now.withColumn("ready", F.col("ready") + F.lit(start))
        at = F.concat_ws(" ", F.lit(f"{n_round:06d}"), F.format_string("%014.3f", F.col("ready")))
        order = now.select("key", at.alias("at"), F.concat_ws(" ", at, "arrival").alias("arrival"))
        pages = fetch(now.select("url", "depth", "host", "key", "ready")).join(order, "key")
        pages = materialise(pages.withColumn("fingerprint", fingerprints("text")), "pages")
        kept = first_kept(pages.where(storable(pages)), stored, settings.near_bits)
        own = pages.join(kept, "arrival", "left_semi")
        stored = own if stored is None else stored.unionByName(own)
        n_stored += kept.count()
        if settings.max_pages is not None and n_stored >= settings.max_pages:
            stored = stored.orderBy("arrival").limit(settings.max_pages)
            break
        todo = followed(pages, settings.max_depth)
        n_round, start = n_round + 1, start + last + max(settings.delay, now.agg(F.max("wait")).first()[0])
    return stored, refused


def summary(records: DataFrame, refused: DataFrame) -> DataFrame:
    """One row: pages, hosts, bytes of text, and refusals by reason as a map."""
    by = refused.groupBy("refusal").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("refusal", "n")))).alias("m"))
    return records.agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"), F.sum(F.octet_length("text")).alias("text_bytes")).withColumn("refused", by.scalar())
