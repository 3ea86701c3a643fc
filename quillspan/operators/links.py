"""The host graph: edges, degrees, trust and the authority table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import damped
from ..functions.urls import host_node
from ..session import materialise
from .anchors import with_sites

DAMPING, PRECISION, MOST_ROUNDS = 0.85, 1e-9, 2000


def graph_links(docs: DataFrame) -> DataFrame:
    """One row per link: (crawl_doc, src, dst, outcome); outcome is nofollow, unparseable, same_site, repeat or counted.
    A page votes once for a target host; its later links there are repeats."""
    links = docs.select("crawl_doc", host_node(F.col("final_url")).alias("src"), F.posexplode("links").alias("link_no", "link")).where("src is not null and src <> ''")
    flat = with_sites(links.select("crawl_doc", "link_no", "src", host_node(F.col("link.url")).alias("dst"), F.coalesce("link.nofollow", F.lit(False)).alias("nofollow")), ["src", "dst"])
    outcome = F.when(F.col("nofollow"), "nofollow").when(F.col("dst").isNull() | (F.col("dst") == ""), "unparseable").when(F.col("site_src") == F.col("site_dst"), "same_site").otherwise("counted")
    flat = flat.withColumn("outcome", outcome)
    turn = F.row_number().over(Window.partitionBy("crawl_doc", "dst", "outcome").orderBy("link_no"))
    return flat.withColumn("outcome", F.when((F.col("outcome") == "counted") & (turn > 1), "repeat").otherwise(F.col("outcome"))).select("crawl_doc", "src", "dst", "outcome")


def edges(docs: DataFrame) -> DataFrame:
    """(src, dst, pages): pages of src that link to dst."""
    return graph_links(docs).where("outcome = 'counted'").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def dropped(docs: DataFrame) -> DataFrame:
    return graph_links(docs).groupBy("outcome").agg(F.count(F.lit(1)).alias("links"))


def hosts(docs: DataFrame, edges_: DataFrame, seeds: list[str] = ()) -> DataFrame:
    """(host, pages, is_seed): crawled hosts, linked hosts and seeds, linked or not."""
    spark = docs.sparkSession
    pages = docs.select(host_node(F.col("final_url")).alias("host")).where("host is not null and host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seed = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "host string")
    every = pages.select("host").union(edges_.select("src")).union(edges_.select("dst")).union(seed).distinct()
    return every.join(pages, "host", "left").join(seed.withColumn("is_seed", F.lit(True)), "host", "left").select("host", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("is_seed", F.lit(False)).alias("is_seed"))


def degrees(hosts_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(host, in_degree, out_degree): distinct hosts on the other end."""
    come, go = edges_.groupBy(F.col("dst").alias("host")).agg(F.count(F.lit(1)).alias("in_degree")), edges_.groupBy(F.col("src").alias("host")).agg(F.count(F.lit(1)).alias("out_degree"))
    return hosts_.select("host").join(come, "host", "left").join(go, "host", "left").fillna(0)


def rounds_needed(damping: float = DAMPING, precision: float = PRECISION) -> int:
    if not 0 < damping < 1:
        return 1
    return min(MOST_ROUNDS, math.ceil(math.log(precision / 2) / math.log(damping)) + 1)


def trust_rank(hosts_: DataFrame, edges_: DataFrame, damping: float = DAMPING, rounds: int | None = None, keep_every: int = 2) -> DataFrame:
    """(host, trust): random walks that start at the seeds and, at hosts without links, go back there; without
    seeds every host is one. A host's trust is shared alike by the hosts it links to, whatever the number of pages.
    With rounds unset it ends once a round moves less than PRECISION. Each round reads the vector three times, so
    it is written to the shared folder every other round: plans stay short and a lost executor repeats little."""
    most = rounds_needed(damping) if rounds is None else rounds
    n, seeds = hosts_.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_seed"), 1))).first()
    jump = F.when(F.col("is_seed"), F.lit(1.0 / max(seeds, 1))).otherwise(0.0) if seeds else F.lit(1.0 / max(n, 1))
    out = edges_.groupBy(F.col("src").alias("host")).agg(F.count(F.lit(1)).alias("out"))
    base = materialise(hosts_.select("host", jump.alias("jump")).join(out, "host", "left"), "trust-base")
    now = base.withColumn("trust", F.col("jump")).withColumn("was", F.lit(0.0))
    links = edges_.select(F.col("src").alias("from"), F.col("dst").alias("to"))
    for i in range(most):
        sent = now.join(links, now.host == links["from"]).groupBy(F.col("to").alias("host")).agg(F.sum(F.col("trust") / F.col("out")).alias("got"))
        lost = now.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("trust"))), F.lit(0.0)).alias("lost"))
        now = now.join(sent, "host", "left").withColumn("lost", lost.scalar()).select("host", "jump", "out", (damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("jump")) + (1 - damping) * F.col("jump")).alias("next"), F.col("trust").alias("was")).withColumnRenamed("next", "trust")
        if (i + 1) % keep_every == 0:
            now = materialise(now, "trust")
            if rounds is None and (i + 1) % 10 == 0 and (now.agg(F.sum(F.abs(F.col("trust") - F.col("was")))).first()[0] or 0.0) < PRECISION:
                break
    return now.select("host", "trust")


def authority(docs: DataFrame, seeds: list[str], damping: float = DAMPING) -> DataFrame:
    """(host, pages, in_degree, trust, factor_indegree, factor_trust)."""
    e = materialise(edges(docs), "edges")
    h = materialise(hosts(docs, e, seeds), "hosts")
    rows = h.join(degrees(h, e), "host").join(trust_rank(h, e, damping), "host")
    return with_factors(rows.select("host", "pages", "in_degree", "trust"))


def with_factors(rows: DataFrame) -> DataFrame:
    """Both measures damped to 0..1; trust is scaled to whole numbers of its least share first."""
    most_in, most_trust = rows.agg(F.max("in_degree")).scalar(), rows.agg(F.max("trust")).scalar()
    return rows.withColumn("factor_indegree", damped(F.col("in_degree"), most_in)).withColumn("factor_trust", damped(F.col("trust"), most_trust))


def ranking(rows: DataFrame, measure: str) -> DataFrame:
    """(host, value, place): greatest first, ties by name. Hosts are few against pages; one task sorts them."""
    return rows.select("host", F.col(measure).alias("value"), F.row_number().over(Window.orderBy(F.desc(measure), "host")).alias("place"))


def rank_correlation(rows: DataFrame, one: str, two: str) -> DataFrame:
    """One row (hosts, rho): Spearman's formula on two rankings; null below two hosts."""
    a, b = ranking(rows, one).select("host", F.col("place").alias("p")), ranking(rows, two).select("host", F.col("place").alias("q"))
    d = a.join(b, "host").agg(F.count(F.lit(1)).alias("hosts"), F.sum((F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))).alias("d2"))
    return d.select("hosts", F.when(F.col("hosts") > 1, 1 - 6.0 * F.col("d2") / (F.col("hosts").cast("double") * (F.col("hosts") * F.col("hosts") - 1))).alias("rho"))


def write_authority(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def read_authority(spark, path: str) -> DataFrame | None:
    """The table, or None where there is none; a file of another shape is an error."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    df = spark.read.parquet(path)
    missing = {"host", "pages", "in_degree", "trust", "factor_indegree", "factor_trust"} - set(df.columns)
    if missing:
        raise ValueError(f"authority table without {sorted(missing)}")
    return df
