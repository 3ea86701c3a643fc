"""Ranked boolean search over an index, for any number of queries in one plan.

The terms of a batch are known before its plan is made, so only their rows are read from
the postings, in the order of terms: once for the counts, from which one aggregation by
query and document tells which documents match and how they score, and once for the
positions of those that survive the first cut. Windows rank within a query and a
segment, whose size is bounded; what goes on to the ranking of the whole query is the
best of each segment. Texts are read late, for hits only.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIELDS, IDF, QUALITY
from .index import Index

#: Parts of a batch of queries up to which its terms are put into the plan; a larger batch is joined as a table.
MOST_PARTS = 10_000


@dataclass(frozen=True)
class Weights:
    body: float = 1.0
    title: float = 3.0
    heading: float = 2.0
    url: float = 1.5
    anchor: float = 2.5
    k1: float = 1.2
    b_body: float = 0.75
    b_title: float = 0.3
    b_heading: float = 0.5
    b_url: float = 0.3
    b_anchor: float = 0.3
    proximity: float = 0.6
    authority: float = 0.3
    quality: float = 0.4


@dataclass(frozen=True)
class Options:
    limit: int = 10
    weights: Weights = Weights()
    #: Documents of each segment whose proximity is measured; None measures all.
    rescore_depth: int | None = 100


@dataclass(frozen=True)
class Batch:
    """The parts of a batch of queries with what the index knows of them, and the postings of their terms."""

    #: query_id, kind, part, place, term, n (terms of the query), df (documents of the term), site
    parts: DataFrame
    postings: DataFrame
    kinds: frozenset[str]
    #: Whether some query has more than one term.
    several: bool

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.parts.where(F.col("kind").isin(*kinds))


def batch_of(index: Index, parts: DataFrame, most_parts: int | None = None) -> Batch:
    """Queries of which a term stands nowhere ask for nothing; they are left out before the postings are read."""
    most = MOST_PARTS if most_parts is None else most_parts
    rows = parts.select("query_id", "kind", "part", "place", "term").limit(most + 1).collect()
    if len(rows) > most:
        return _large_batch(index, parts.distinct())
    rows = list(dict.fromkeys(rows))
    words = sorted({r.term for r in rows if r.kind != "site"})
    df = {r.term: r.df for r in index.dictionary.where(F.col("term").isin(words)).collect()} if words else {}
    needed: dict[int, set] = {}
    sites = {r.query_id: r.term for r in rows if r.kind == "site"}
    for r in rows:
        if r.kind == "term":
            needed.setdefault(r.query_id, set()).add(r.term)
    alive = {q for q, terms in needed.items() if all(t in df for t in terms)}
    vain = {(r.query_id, r.part) for r in rows if r.kind == "not_phrase" and r.term not in df}
    kept = [r for r in rows if r.query_id in alive and r.kind != "site" and r.term in df and not (r.kind == "not_phrase" and (r.query_id, r.part) in vain)]
    columns = {"query_id": pa.int64(), "kind": pa.string(), "part": pa.int32(), "place": pa.int32(), "term": pa.string()}
    data = {c: pa.array([r[c] for r in kept], t) for c, t in columns.items()}
    data |= {"n": pa.array([len(needed[r.query_id]) for r in kept], pa.int64()), "df": pa.array([df[r.term] for r in kept], pa.int64()), "site": pa.array([sites.get(r.query_id) for r in kept], pa.string())}
    # At most as many rows as a batch may have parts.
    known = F.broadcast(parts.sparkSession.createDataFrame(pa.table(data)))
    chosen = index.postings.where(F.col("term").isin(sorted({r.term for r in kept})))
    return Batch(known, chosen, frozenset(r.kind for r in kept), any(len(needed[q]) > 1 for q in alive))


def _large_batch(index: Index, parts: DataFrame) -> Batch:
    sizes = parts.where("kind = 'term'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    sites = parts.where("kind = 'site'").select("query_id", F.col("term").alias("site"))
    known = parts.where("kind <> 'site'").join(sizes, "query_id").join(sites, "query_id", "left").join(index.dictionary, "term", "left")
    words = known.select("term").distinct()
    return Batch(known, index.postings.join(words, "term", "left_semi"), frozenset({"term", "phrase", "not_term", "not_phrase"}), True)


def phrase_hits(postings: DataFrame, phrases: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, part, crawl_doc): documents among those found that hold a phrase, its words on consecutive positions."""
    phrases = phrases.select("query_id", "part", "place", "term")
    sizes = phrases.groupBy("query_id", "part").agg(F.count(F.lit(1)).alias("n"))
    own = postings.select("term", "crawl_doc", "positions").join(phrases, "term").join(found.select("query_id", "crawl_doc"), ["query_id", "crawl_doc"], "left_semi")
    placed = own.select("query_id", "part", "crawl_doc", "place", F.explode("positions").alias("p"))
    starts = placed.groupBy("query_id", "part", "crawl_doc", (F.col("p") - F.col("place")).alias("start")).agg(F.count_distinct("place").alias("k"))
    return starts.join(sizes, ["query_id", "part"]).where("k = n").select("query_id", "part", "crawl_doc").distinct()


def _held(index: Index, batch: Batch) -> DataFrame:
    """(query_id, crawl_doc, site, terms): documents that hold every term and phrase of a query and nothing it excludes, with
    the counts of each term."""
    counts = [f"c_{f}" for f in FIELDS]
    wanted = batch.of_kind("term", "not_term").select("query_id", "term", "n", "df", "site", (F.col("kind") == "not_term").alias("no"))
    own = batch.postings.select("term", "crawl_doc", *counts).join(wanted, "term")
    yes = ~F.col("no")
    held = own.groupBy("query_id", "crawl_doc").agg(F.sum(yes.cast("int")).alias("k"), F.max("n").alias("n"), F.max("no").alias("bad"), F.max("site").alias("site"), F.collect_list(F.when(yes, F.struct("term", "df", *counts))).alias("terms"))
    found = held.where("k = n and not bad").select("query_id", "crawl_doc", "site", "terms")
    if "phrase" in batch.kinds:
        phrases = batch.of_kind("phrase")
        needed = phrases.groupBy("query_id").agg(F.count_distinct("part").alias("parts"))
        hits = phrase_hits(batch.postings, phrases, found).groupBy("query_id", "crawl_doc").agg(F.count(F.lit(1)).alias("k"))
        found = found.join(needed, "query_id", "left").join(hits, ["query_id", "crawl_doc"], "left").where("parts is null or k = parts").drop("parts", "k")
    if "not_phrase" in batch.kinds:
        found = found.join(phrase_hits(batch.postings, batch.of_kind("not_phrase"), found), ["query_id", "crawl_doc"], "left_anti")
    return found


def _matched(index: Index, batch: Batch, *columns: str) -> DataFrame:
    """The documents held that are also of the site asked for, with columns of the document table."""
    docs = index.doc_table.select("crawl_doc", "site_key", *columns)
    return _held(index, batch).join(docs, "crawl_doc").where("site is null or site = site_key").drop("site")


def matches(index: Index, parts: DataFrame) -> DataFrame:
    """(query_id, crawl_doc): terms and phrases all held, nothing excluded held, site met."""
    return _matched(index, batch_of(index, parts)).select("query_id", "crawl_doc")


# The expressions below are text, as a search waits for its plan: parsing is much faster than building them one by one.


def _norm(f: str, w: Weights) -> str:
    """What a count in a field of the row's document is divided by."""
    b = getattr(w, f"b_{f}")
    return f"case when stats.avg_{f} > 0 then {1 - b}d + {b}d * len_{f} / stats.avg_{f} else 1.0d end as norm_{f}"


def _term(w: Weights) -> str:
    """A term's counts -> the same with its idf and its weighted count over all fields, each normalised by the field's length."""
    counts = ", ".join(f"'c_{f}', t.c_{f}" for f in FIELDS)
    tf = " + ".join(f"{getattr(w, f)}d * t.c_{f} / norm_{f}" for f in FIELDS)
    return f"t -> named_struct('term', t.term, 'df', t.df, 'idf', {IDF}, {counts}, 'tf', {tf})"


def _contribution(w: Weights) -> str:
    kept = ", ".join(f"'{c}', t.{c}" for c in ("term", "df", "idf", *(f"c_{f}" for f in FIELDS), "tf"))
    return f"t -> named_struct({kept}, 'contribution', t.idf * t.tf / ({w.k1}d + t.tf))"


def _spans(lists: Column, n: Column) -> Column:
    """The shortest stretch of positions that holds every one of n terms. lists: structs of a term's number t and its positions.
    One walk over all positions keeps the last place of each term."""
    every = F.array_sort(F.flatten(F.transform(lists, lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("p"), x["t"].alias("t"))))))
    start = F.struct(F.array_repeat(F.lit(None).cast("int"), n.cast("int")).alias("lasts"), F.lit(None).cast("int").alias("best"))

    def step(acc: Column, x: Column) -> Column:
        lasts = F.transform(acc["lasts"], lambda v, i: F.when(i == x["t"], x["p"]).otherwise(v))
        span = F.when(~F.exists(lasts, lambda v: v.isNull()), x["p"] - F.array_min(lasts))
        return F.struct(lasts.alias("lasts"), F.least(acc["best"], span).alias("best"))

    return F.when(n > 1, F.aggregate(every, start, step, lambda acc: acc["best"]))


def closest_spans(postings: DataFrame, found: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, crawl_doc, n_terms, span): the shortest stretch of positions that holds every term of the query;
    null for queries of one term. Runs over the positions of the given documents only."""
    terms = parts.where("kind = 'term'").select("query_id", F.col("part").alias("t"), "term")
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    own = postings.select("term", "crawl_doc", "positions").join(terms, "term").join(found.select("query_id", "crawl_doc"), ["query_id", "crawl_doc"])
    lists = own.groupBy("query_id", "crawl_doc").agg(F.collect_list(F.struct("t", "positions")).alias("lists")).join(sizes, "query_id")
    return lists.select("query_id", "crawl_doc", F.col("n").alias("n_terms"), _spans(F.col("lists"), F.col("n")).alias("span"))


def _with_spans(rows: DataFrame, batch: Batch) -> DataFrame:
    """Adds n_terms and span. The positions meet the surviving rows, which are planned once."""
    if not batch.several:
        return rows.withColumns({"n_terms": F.lit(1).cast("bigint"), "span": F.lit(None).cast("int")})
    terms = batch.of_kind("term").select("query_id", F.col("part").alias("t"), "term", F.col("n").alias("n_terms"))
    positions = batch.postings.select("term", "crawl_doc", "positions").join(terms.where("n_terms > 1"), "term")
    met = rows.join(positions.drop("term"), ["query_id", "crawl_doc"], "left")
    keys = ["query_id", "crawl_doc"]
    others = [c for c in rows.columns if c not in keys]
    out = met.groupBy(*keys).agg(F.first(F.struct(*others)).alias("row"), F.coalesce(F.max("n_terms"), F.lit(1)).alias("n_terms"), F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "positions"))).alias("lists"))
    return out.select(*keys, "row.*", "n_terms", _spans(F.col("lists"), F.col("n_terms")).alias("span"))


def proximity_bonus(terms: Column, span: Column, weight: float) -> Column:
    loose = F.greatest(span - (terms - 1), F.lit(0))
    return F.when((terms > 1) & span.isNotNull(), weight * terms / (1.0 + loose)).otherwise(F.lit(0.0))


def scored(index: Index, parts: DataFrame, options: Options = Options(), authority: DataFrame | None = None, factor: str = "factor_indegree") -> DataFrame:
    """The matches that survive the first cut with their score and the parts of it. ``in_segment`` counts the matches of
    the query in the row's segment before any cut."""
    w = options.weights
    batch = batch_of(index, parts)
    rows = _matched(index, batch, "segment", "host", "text_ratio", "link_density", "scripts", *(f"len_{f}" for f in FIELDS))
    stats = index.stats.select(F.struct("n_docs", *(f"avg_{f}" for f in FIELDS))).scalar()
    keep = ["query_id", "crawl_doc", "site_key", "segment", "host"]
    normed = rows.withColumn("stats", stats).selectExpr(*keep, "terms", "stats", f"{w.quality}d * {QUALITY} as quality", *(_norm(f, w) for f in FIELDS))
    rows = normed.selectExpr(*keep, "quality", f"transform(array_sort(transform(terms, {_term(w)})), {_contribution(w)}) as terms")
    rows = rows.selectExpr("*", "aggregate(terms, 0.0d, (total, t) -> total + t.contribution) as text_relevance")
    if authority is None:
        rows = rows.withColumn("authority", F.lit(0.0)).withColumn("authority_known", F.lit(None).cast("boolean"))
    else:
        hosts = authority.select(F.col("host").alias("site_key"), F.least(F.greatest(F.col(factor), F.lit(0.0)), F.lit(1.0)).alias("factor"))
        rows = rows.join(hosts, "site_key", "left").withColumn("authority_known", F.col("factor").isNotNull()).withColumn("authority", w.authority * F.coalesce("factor", F.lit(0.0))).drop("factor")
    rows = rows.withColumn("first_score", F.round(F.col("text_relevance") + F.col("authority") + F.col("quality"), 6))
    rows = rows.withColumn("in_segment", F.count(F.lit(1)).over(Window.partitionBy("query_id", "segment")))
    if options.rescore_depth is not None:
        depth = max(options.rescore_depth, options.limit, 1)
        best = Window.partitionBy("query_id", "segment").orderBy(F.desc("first_score"), "crawl_doc")
        rows = rows.withColumn("cut", F.row_number().over(best)).where(F.col("cut") <= depth).drop("cut")
    rows = _with_spans(rows, batch)
    rows = rows.withColumn("proximity", proximity_bonus(F.col("n_terms"), F.col("span"), w.proximity))
    # Rounded, so that documents tie alike however a cluster happens to order its sums.
    return rows.withColumn("score", F.round(F.col("text_relevance") + F.col("proximity") + F.col("authority") + F.col("quality"), 6))


def search(index: Index, parts: DataFrame, options: Options = Options(), authority: DataFrame | None = None, factor: str = "factor_indegree") -> DataFrame:
    """The best ``limit`` documents of each query; ties go to the lower document. ``matched`` counts the matches before any cut."""
    rows = scored(index, parts, options, authority, factor)
    order = (F.desc("score"), "crawl_doc")
    # The best of each segment first, so that the window of a query holds at most limit rows of each.
    local = rows.withColumn("local", F.row_number().over(Window.partitionBy("query_id", "segment").orderBy(*order))).where(F.col("local") <= max(options.limit, 1))
    every = Window.partitionBy("query_id")
    top = local.withColumn("matched", F.sum(F.when(F.col("local") == 1, F.col("in_segment"))).over(every))
    top = top.withColumn("rank", F.row_number().over(every.orderBy(*order))).where(F.col("rank") <= options.limit)
    explained = F.struct("text_relevance", "proximity", F.col("span").alias("closest_span"), F.struct(F.col("authority").alias("value"), F.col("authority_known").alias("known")).alias("authority"), "quality", "terms")
    return top.select("query_id", "rank", "crawl_doc", "host", "score", "matched", explained.alias("explanation"))


def with_records(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Titles, addresses and texts of the hits, read after the cut."""
    late = records.select("crawl_doc", "url", "final_url", "title", "text", "snippet_allowed", "max_snippet")
    return late.join(hits, "crawl_doc").dropDuplicates(["query_id", "rank"])
