"""One query per operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, html, robots, simhash, snippets, urls
from ..functions.text import FIELDS, field_lengths, field_tokens
from ..operators import anchors, dedupe, evaluate, frontier, index, links, query, search
from ..session import materialise, shared_dir, table
from ..sources import store
from ..streaming import ingest

Run = Callable[[SparkSession, str], DataFrame]

#: Query texts of the search queries, by name. Every form of the language occurs.
SEARCHES = {
    "search_single": {1: "lantern"},
    "search_and": {1: "quiet letter", 2: "workshop garden notebook", 3: "the of"},
    "search_phrase": {1: '"worth more than"', 2: 'garden "quiet letter"', 3: "storm-line garden"},
    "search_exclude": {1: "garden -winter -letter", 2: "-garden", 3: "zebrafishes garden"},
    "search_exclude_phrase": {1: 'letter -"worth more than"', 2: 'garden -"quiet letter" -winter'},
    "search_site": {1: "letter site:teltov.test", 2: "the site:www.notes.jotir.test"},
}
EXACT = search.Options(rescore_depth=None)
RESCORED = search.Options(limit=10, rescore_depth=20)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.crawl_docs(table(spark, sf_dir, "records"))


def host_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "host_scores").select("host", "factor_indegree", "factor_trust")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_tokens(index.indexable(docs_of(spark, sf_dir)), index.fields_of(False))


def tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("crawl_doc", F.col("field").cast("bigint").alias("field"), F.col("position").cast("bigint").alias("position"), "term")


def field_length(spark, sf_dir):
    return field_lengths(_tokens(spark, sf_dir), FIELDS)


def postings(spark, sf_dir):
    """Positions as text, so that engines compare them alike."""
    p = index.of_tables(spark, sf_dir).postings
    return p.select("term", "crawl_doc", *(f"c_{f}" for f in FIELDS), F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions"))


def dictionary(spark, sf_dir):
    return index.of_tables(spark, sf_dir).dictionary


def corpus_stats(spark, sf_dir):
    s = index.of_tables(spark, sf_dir).stats
    return s.select("n_docs", *(F.round(f"avg_{f}", 6).alias(f"avg_{f}") for f in FIELDS))


def host_table(spark, sf_dir):
    return index.of_tables(spark, sf_dir).doc_table.groupBy("host").agg(F.count(F.lit(1)).alias("documents"))


def doc_table(spark, sf_dir):
    d = index.of_tables(spark, sf_dir).doc_table
    return d.select("crawl_doc", "host", *(f"len_{f}" for f in FIELDS), F.round("text_ratio", 3).alias("text_ratio"), F.round("link_density", 3).alias("link_density"), "scripts")


def segment_ids(spark, sf_dir):
    return index.segments(index.indexable(docs_of(spark, sf_dir)), 100)


def merged_dictionary(spark, sf_dir):
    """Two halves of the crawl indexed apart and merged; terms and statistics are those of the whole."""
    records = table(spark, sf_dir, "records")
    halves = [index.build(records.where(F.col("crawl_doc") % 2 == i), anchors=False) for i in (0, 1)]
    both = index.merged(*halves)
    return both.dictionary.withColumn("n_docs", both.stats.select("n_docs").scalar())


def index_totals(spark, sf_dir):
    return index.totals(index.of_tables(spark, sf_dir))


def _gaps(spark, sf_dir) -> DataFrame:
    """(term, part, crawl_doc, gap): gaps between the documents of each term. A term's list is cut into parts by ranges of ids,
    so no task sorts all documents of a common term; a part's first gap begins at the last document of the part before."""
    p = index.of_tables(spark, sf_dir).postings.select("term", "crawl_doc", F.floor(F.col("crawl_doc") / 65536).alias("part"))
    ends = p.groupBy("term", "part").agg(F.max("crawl_doc").alias("last"))
    before = ends.select("term", "part", F.coalesce(F.lag("last").over(Window.partitionBy("term").orderBy("part")), F.lit(0)).alias("before"))
    previous = F.lag("crawl_doc").over(Window.partitionBy("term", "part").orderBy("crawl_doc"))
    return p.withColumn("previous", previous).join(before, ["term", "part"]).select("term", "part", "crawl_doc", (F.col("crawl_doc") - F.coalesce("previous", "before")).alias("gap"))


def position_gaps(spark, sf_dir):
    """Per term: gaps between its documents and the bits they need, whole and by the widest."""
    bits = F.when(F.col("gap") > 0, F.floor(F.log2("gap")) + 1).otherwise(0)
    return _gaps(spark, sf_dir).withColumn("bits", bits).groupBy("term").agg(F.count(F.lit(1)).alias("gaps"), F.sum("bits").cast("bigint").alias("bits"), F.max("bits").cast("bigint").alias("widest"))


def codec_sizes(spark, sf_dir):
    """Bytes of all document gaps in each codec. The parts of a term's list are coded apart, in blocks."""
    p = _gaps(spark, sf_dir).repartition("term", "part").sortWithinPartitions("term", "part", "crawl_doc").select("term", "part", "gap")

    def run(frames):
        import pandas as pd

        sums, values, chunk, of = dict.fromkeys(codecs.CODECS, 0), 0, [], None

        def coded():
            for name, (enc, _) in codecs.CODECS.items():
                sums[name] += len(enc(chunk)) if chunk else 0

        for f in frames:
            for t, part, gap in zip(f["term"], f["part"], f["gap"].tolist()):
                if (t, part) != of or len(chunk) >= codecs.BLOCK:
                    coded()
                    values += len(chunk)
                    chunk, of = [], (t, part)
                chunk.append(gap)
        coded()
        yield pd.DataFrame({"codec": list(sums), "bytes": list(sums.values()), "gaps": values + len(chunk)})

    return p.mapInPandas(run, "codec string, bytes bigint, gaps bigint").groupBy("codec").agg(F.sum("bytes").alias("bytes"), F.sum("gaps").alias("gaps"))


def front_coding(spark, sf_dir):
    """Bytes of the sorted dictionary plain and front-coded. A term is coded as the bytes it shares with the one before, the
    bytes that follow, and these; both numbers are one byte, as no term is longer than 40. Coding begins anew with each two letters."""
    d = index.of_tables(spark, sf_dir).dictionary.select("term", F.substring("term", 1, 2).alias("head"))
    d = d.withColumn("before", F.coalesce(F.lag("term").over(Window.partitionBy("head").orderBy("term")), F.lit("")))
    letters = F.aggregate(F.sequence(F.lit(1), F.length("term")), F.lit(0), lambda n, i: F.when(F.substring(F.col("term"), F.lit(1), i) == F.substring(F.col("before"), F.lit(1), i), i).otherwise(n))
    shared = F.octet_length(F.substring(F.col("term"), F.lit(1), letters))
    return d.agg(F.count(F.lit(1)).alias("terms"), F.sum(F.octet_length("term")).alias("plain"), F.sum(2 + F.octet_length("term") - shared).alias("coded"))


def size_report(spark, sf_dir):
    kept = index.indexable(docs_of(spark, sf_dir))
    return kept.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text")).alias("text_bytes"), F.round(F.avg(F.octet_length("text")), 4).alias("mean_bytes"))


def store_summary(spark, sf_dir):
    s = store.summary(docs_of(spark, sf_dir))
    return s.select("pages", "hosts", "text_bytes", "deepest", "first_fetch", "last_fetch", F.array_join(F.transform(F.array_sort(F.map_entries("by_status")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), " ").alias("by_status"))


def point_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "hits").where(F.col("query_id") == 1).select("crawl_doc")
    return store.lookup(docs_of(spark, sf_dir), wanted).select("crawl_doc", "url", F.length("text").alias("chars"))


def blank_texts(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("records"), F.count(F.when(index.not_blank(F.col("text")), 1)).alias("indexed")).withColumn("skipped", F.col("records") - F.col("indexed"))


# --- Addresses -------------------------------------------------------------------------------


def url_hosts(spark, sf_dir):
    u = F.col("url")
    return docs_of(spark, sf_dir).select("crawl_doc", urls.host_raw(u).alias("host"), urls.host_node(u).alias("node"))


def url_tokens(spark, sf_dir):
    t = _tokens(spark, sf_dir).where(F.col("field") == FIELDS.index("url"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("crawl_doc").alias("documents"))


def url_keys(spark, sf_dir):
    normal = urls.normal_url(F.col("url"))
    return docs_of(spark, sf_dir).select("crawl_doc", normal.alias("normal"), urls.dedupe_key(normal).alias("key"))


def trap_reasons(spark, sf_dir):
    links_ = docs_of(spark, sf_dir).select("depth", F.explode("links").alias("l")).select(F.col("l.url").alias("url"), (F.col("depth") + 1).alias("depth")).distinct()
    return links_.where(urls.admissible(F.col("url"))).withColumn("reason", F.coalesce(urls.trap(F.col("url"), F.col("depth"), F.lit(0)), F.lit("none"))).groupBy("reason").agg(F.count(F.lit(1)).alias("links"))


def registrable_domains(spark, sf_dir):
    d = docs_of(spark, sf_dir).select(urls.host_node(F.col("url")).alias("host")).distinct()
    return d.withColumn("domain", urls.site_udf()("host"))


def frontier_admission(spark, sf_dir):
    """What becomes of the links of the crawl as candidates of a next round, against the addresses stored."""
    d = docs_of(spark, sf_dir)
    seen = d.select(urls.dedupe_key(urls.normal_url(F.col("url"))).alias("key"))
    c = d.select("crawl_doc", "depth", F.posexplode("links").alias("no", "l")).where(~F.coalesce(F.col("l.nofollow"), F.lit(False)))
    c = c.select(F.col("l.url").alias("url"), (F.col("depth") + 1).alias("depth"), F.concat(F.lpad(F.col("crawl_doc").cast("string"), 20, "0"), F.lpad(F.col("no").cast("string"), 8, "0")).alias("arrival"))
    return frontier.judged(c, seen=seen).groupBy(F.coalesce("refusal", F.lit("admitted")).alias("outcome")).agg(F.count(F.lit(1)).alias("candidates"))


def politeness(spark, sf_dir):
    """When each record's address would be fetched, one host one address at a time."""
    d = docs_of(spark, sf_dir).select("crawl_doc", "url", urls.host_node(F.col("url")).alias("host"), F.lpad(F.col("crawl_doc").cast("string"), 20, "0").alias("arrival"))
    return frontier.schedule(d, 3.0).select("crawl_doc", "host", F.col("turn").cast("bigint").alias("turn"), "ready")


def _page_html(d: DataFrame) -> DataFrame:
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(F.split(esc(F.col("text")), "\n"), lambda p: F.concat(F.lit("<p>"), p)), "\n")
    anchors_ = F.array_join(F.transform(F.coalesce("links", F.array()), lambda x: F.concat(F.lit('<li><a href="'), x["url"], F.lit('">'), esc(x["anchor"]), F.lit("</a>"))), "")
    heads = F.array_join(F.transform(F.coalesce("headings", F.array()), lambda h: F.concat(F.lit("<h2>"), esc(h), F.lit("</h2>"))), "")
    return d.select("crawl_doc", "url", "depth", F.concat(F.lit("<html lang=en><head><title>"), esc(F.col("title")), F.lit("</title><script>1</script></head><body><div class='site nav'>menu</div><article>"), heads, body, F.lit("</article><ul class=related>"), anchors_, F.lit("</ul></body></html>")).alias("html"))


def extract_pages(spark, sf_dir):
    """Pages rendered from the records and read back by the extractor."""
    p = html.extract(_page_html(docs_of(spark, sf_dir)), "crawl_doc", "url", "html")
    return p.select("crawl_doc", "title", F.length("text").alias("chars"), F.size("headings").alias("headings"), F.size("links").alias("links"), F.round("quality.text_ratio", 4).alias("text_ratio"), F.col("quality.scripts").alias("scripts"), F.col("quality.words").alias("words"))


def crawl_rounds(spark, sf_dir):
    """A crawl over the stored pages as if they were the web, from all pages of depth 0 and without a cap on pages
    or hosts. Of pages under one key, the first stored is the one read."""
    keyed = docs_of(spark, sf_dir).withColumn("key", urls.dedupe_key(urls.normal_url(F.col("url"))))
    first = materialise(keyed.where("key is not null").groupBy("key").agg(F.min("crawl_doc").alias("crawl_doc")), "first")
    web = materialise(_page_html(docs_of(spark, sf_dir)).join(first, "crawl_doc").select("key", "html"), "web")

    def fetch(todo: DataFrame) -> DataFrame:
        pages = todo.join(web, "key")
        read = html.extract(pages, "key", "url", "html")
        return pages.select("key", "depth", "host").join(read, "key").select("url", "depth", "host", "key", "title", "text", "headings", "links", "directives")

    seeds = docs_of(spark, sf_dir).where("depth = 0").select("url")
    records, _ = frontier.crawl(seeds, fetch, frontier.Settings(max_pages=None, max_per_host=None, per_host_and_round=None))
    return records.groupBy("depth").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"))


def robots_verdicts(spark, sf_dir):
    """Each address against a robots text of its host."""
    d = docs_of(spark, sf_dir).select("crawl_doc", urls.path_of(F.col("url")).alias("path"))
    body = "User-agent: *\nDisallow: /archive/\nAllow: /archive/*-5\nDisallow: /*.html$\nCrawl-delay: 3"
    return d.select("crawl_doc", robots.allowed("quillspan")(F.lit(body), "path").alias("allowed"))


def robots_by_host(spark, sf_dir):
    """Addresses that are admissible by themselves, by what the robots answers of their hosts make of them. The answers are made up
    from the length of a host's name: none, refused, failing, or one of two sets of rules."""
    kind = F.length("host") % 5
    status = F.when(kind == 0, 404).when(kind == 1, 403).when(kind == 2, 503).otherwise(200)
    body = F.when(kind == 3, "User-agent: *\nDisallow: /archive/\nAllow: /archive/*-5\nCrawl-delay: 7").when(kind == 4, "User-agent: other\nDisallow: /\n\nUser-agent: quillspan\nDisallow: /*.html$")
    table_ = table(spark, sf_dir, "host_scores").select("host", status.alias("status"), body.alias("body"))
    rows = frontier.judged(docs_of(spark, sf_dir).select("url", "depth", F.lpad(F.col("crawl_doc").cast("string"), 20, "0").alias("arrival")))
    kept = frontier.obeying(rows, table_, "quillspan")
    return kept.groupBy(F.coalesce("refusal", F.lit("admitted")).alias("outcome"), "wait").agg(F.count(F.lit(1)).alias("addresses"))


def domain_survey(spark, sf_dir):
    d = docs_of(spark, sf_dir).select(F.regexp_extract(urls.host_node(F.col("url")), r"([^.]+)$", 1).alias("area"), "status", "text", F.col("quality.words").alias("words"))
    return store.survey(d.withColumn("outcome", store.probe_outcome(F.col("status"), F.col("text"), F.lit(None).cast("string"))), "area")


# --- Search ----------------------------------------------------------------------------------


def _search(name: str, options: search.Options = EXACT) -> Run:
    def run(spark, sf_dir):
        hits = search.search(index.of_tables(spark, sf_dir), query.literal(spark, SEARCHES[name]), options, host_factors(spark, sf_dir))
        return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "crawl_doc", "score", "matched")

    return run


def search_rescored(spark, sf_dir):
    hits = search.search(index.of_tables(spark, sf_dir), query.literal(spark, SEARCHES["search_and"]), RESCORED, host_factors(spark, sf_dir))
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "crawl_doc", "score", "matched")


def score_explain(spark, sf_dir):
    """The parts of the scores of one search; they add up to the score."""
    hits = search.search(index.of_tables(spark, sf_dir), query.literal(spark, SEARCHES["search_and"]), EXACT, host_factors(spark, sf_dir))
    e = F.col("explanation")
    return hits.select("query_id", "crawl_doc", *(F.round(e[k], 6).alias(k) for k in ("text_relevance", "proximity", "quality")), F.round(e["authority"]["value"], 6).alias("authority"), e["closest_span"].cast("bigint").alias("span"))


def term_explain(spark, sf_dir):
    hits = search.search(index.of_tables(spark, sf_dir), query.literal(spark, SEARCHES["search_and"]), EXACT, host_factors(spark, sf_dir))
    t = hits.select("query_id", "crawl_doc", F.explode("explanation.terms").alias("t"))
    return t.select("query_id", "crawl_doc", "t.term", "t.df", F.round("t.idf", 6).alias("idf"), F.round("t.tf", 6).alias("tf"), F.round("t.contribution", 6).alias("contribution"))


def proximity_spans(spark, sf_dir):
    ix = index.of_tables(spark, sf_dir)
    parts = query.literal(spark, SEARCHES["search_and"])
    spans = search.closest_spans(ix.postings, search.matches(ix, parts), parts)
    return spans.select("query_id", "crawl_doc", F.col("span").cast("bigint").alias("span"), F.round(search.proximity_bonus(F.col("n_terms"), F.col("span"), 0.6), 6).alias("bonus"))


def judged_search(spark, sf_dir):
    """All judged queries in one batch, with the addresses of their hits."""
    judged = evaluate.clean_judgments(table(spark, sf_dir, "judgments"))
    named = materialise(evaluate.numbered_queries(judged), "queries")
    hits = search.search(index.of_tables(spark, sf_dir), query.parsed(named), search.Options(), host_factors(spark, sf_dir))
    return _named(hits, named, docs_of(spark, sf_dir))


def _named(hits: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    late = docs.select("crawl_doc", "url", "final_url").join(hits, "crawl_doc")
    return late.join(named.withColumnRenamed("text", "query"), "query_id").select("query", "rank", "crawl_doc", "url", "final_url", "score")


def search_snippets(spark, sf_dir):
    hits = search.search(index.of_tables(spark, sf_dir), query.literal(spark, SEARCHES["search_and"]), EXACT, host_factors(spark, sf_dir))
    rows = search.with_records(hits, docs_of(spark, sf_dir)).withColumn("terms", F.transform("explanation.terms", lambda t: t["term"]))
    made = rows.select("query_id", "rank", "crawl_doc", snippets.snippets("text", "terms", "snippet_allowed", "max_snippet").alias("s"))
    return made.select("query_id", "rank", "crawl_doc", "s.text", F.size("s.highlights").alias("highlights"))


# --- Links and anchors -----------------------------------------------------------------------


def _seeds(spark, sf_dir) -> list[str]:
    """The three hosts of the most trust, as a hand-made list would name them."""
    return [r.host for r in table(spark, sf_dir, "host_scores").orderBy(F.desc_nulls_last("trust"), "host").limit(3).collect()]


def host_edges(spark, sf_dir):
    return links.edges(docs_of(spark, sf_dir))


def link_drop_report(spark, sf_dir):
    return links.dropped(docs_of(spark, sf_dir))


def in_degree_authority(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    e = materialise(links.edges(d), "edges")
    h = links.hosts(d, e)
    rows = h.join(links.degrees(h, e), "host").select("host", "pages", "in_degree", "out_degree", F.lit(0.0).alias("trust"))
    return links.with_factors(rows).select("host", "pages", "in_degree", "out_degree", F.round("factor_indegree", 6).alias("factor"))


def trustrank_k10(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    e = materialise(links.edges(d), "edges")
    return links.trust_rank(links.hosts(d, e, _seeds(spark, sf_dir)), e, rounds=10).select("host", F.round("trust", 9).alias("trust"))


def authority_table(spark, sf_dir):
    """Both measures to convergence."""
    rows = links.authority(docs_of(spark, sf_dir), _seeds(spark, sf_dir))
    return rows.select("host", "pages", "in_degree", F.round("trust", 9).alias("trust"), F.round("factor_indegree", 6).alias("factor_indegree"), F.round("factor_trust", 6).alias("factor_trust"))


def rank_correlation(spark, sf_dir):
    rows = table(spark, sf_dir, "host_scores").where("trust is not null and in_degree is not null")
    r = links.rank_correlation(rows, "in_degree", "trust")
    return r.select("hosts", F.round("rho", 6).alias("rho"))


def top_hosts(spark, sf_dir):
    return table(spark, sf_dir, "host_scores").orderBy(F.desc_nulls_last("factor_indegree"), "host").limit(20).select("host", "in_degree", F.round("factor_indegree", 6).alias("factor"))


def anchor_text(spark, sf_dir):
    return anchors.anchor_texts(docs_of(spark, sf_dir))


def anchor_report(spark, sf_dir):
    return anchors.anchor_report(docs_of(spark, sf_dir))


# --- Duplicates ------------------------------------------------------------------------------


def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


def fingerprints(spark, sf_dir):
    """Fingerprints of all texts, and how far the stored ones are from them."""
    d = docs_of(spark, sf_dir).select("crawl_doc", "fingerprint", simhash.fingerprints("text").alias("computed"))
    return d.withColumn("distance", simhash.distance(F.col("fingerprint"), F.col("computed")))


def hamming_pairs(spark, sf_dir):
    """Of stored fingerprints; records with the same one stand behind the same value."""
    return dedupe.hamming_pairs(docs_of(spark, sf_dir)).select("a", "b", F.col("distance").cast("bigint").alias("distance"))


def kept_pages(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("crawl_doc", "fingerprint")
    return dedupe.keep_first(d, dedupe.hamming_pairs(d))


# --- Evaluation ------------------------------------------------------------------------------


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judgments, and the hits of judged queries in two orders: by relevance alone, and with proximity and quality."""
    judged = evaluate.clean_judgments(table(spark, sf_dir, "judgments"))
    names = table(spark, sf_dir, "term_scores").where("query_text is not null").select("query_id", F.lower(F.trim(F.regexp_replace("query_text", r"\s+", " "))).alias("query")).distinct()
    rel = F.when(~F.isnan("text_relevance"), F.col("text_relevance"))
    prox, qual = F.when(~F.isnan("proximity"), F.col("proximity")), F.when(~F.isnan("quality.factor"), F.col("quality.factor"))
    hits = table(spark, sf_dir, "hits").groupBy("query_id", "crawl_doc").agg(F.min("url").alias("url"), F.max(rel).alias("one"), F.max(F.coalesce(rel, F.lit(0.0)) + F.coalesce(prox, F.lit(0.0)) + 0.4 * F.coalesce(qual, F.lit(0.0))).alias("two")).join(names, "query_id")
    ranked = lambda c: hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round(c, 6)), "crawl_doc"))).where(F.col("rank") <= evaluate.DEPTH).select("query", "rank", "url", F.lit(None).cast("string").alias("final_url"))
    return judged, ranked("one"), ranked("two")


def query_metrics(spark, sf_dir):
    judged, one, _ = _runs(spark, sf_dir)
    m = evaluate.metrics(one, judged)
    return m.select("query", "returned", *(F.round(c, 6).alias(c) for c in evaluate.MEASURES))


def eval_summary(spark, sf_dir):
    judged, one, _ = _runs(spark, sf_dir)
    return evaluate.summary(evaluate.metrics(one, judged)).select("queries", *(F.round(c, 6).alias(c) for c in evaluate.MEASURES), "empty_results")


def paired_differences(spark, sf_dir):
    judged, one, two = _runs(spark, sf_dir)
    return evaluate.paired(evaluate.metrics(one, judged), evaluate.metrics(two, judged)).select("query", F.round("difference", 6).alias("difference"))


def randomisation_test(spark, sf_dir):
    judged, one, two = _runs(spark, sf_dir)
    return evaluate.compare(spark, evaluate.metrics(one, judged), evaluate.metrics(two, judged))


def ablation(spark, sf_dir):
    """The judged queries searched with all signals and without each, by mean nDCG."""
    judged = materialise(evaluate.clean_judgments(table(spark, sf_dir, "judgments")), "judged")
    named = materialise(evaluate.numbered_queries(judged), "queries")
    parts = materialise(query.parsed(named), "parts")
    ix, docs, factors = index.of_tables(spark, sf_dir), docs_of(spark, sf_dir), host_factors(spark, sf_dir)
    w = search.Weights
    cases = {"all": (w(), factors), "no authority": (w(), None), "no proximity": (w(proximity=0.0), factors), "no quality": (w(quality=0.0), factors), "no anchors": (w(anchor=0.0), factors)}
    out = None
    for name, (weights, table_) in cases.items():
        hits = search.search(ix, parts, search.Options(weights=weights), table_)
        row = evaluate.summary(evaluate.metrics(_named(hits, named, docs), judged)).select(F.lit(name).alias("signals"), "queries", F.round("ndcg", 6).alias("ndcg"), F.round("coverage", 6).alias("coverage"))
        out = row if out is None else out.unionAll(row)
    return out


# --- Streams ---------------------------------------------------------------------------------


def stream_windows(spark, sf_dir):
    """Hourly counts per type of the events, read as a stream to its end."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    name = f"windows_{abs(hash(sf_dir)) % 10**9}"
    counted = ingest.events_per_window(stream)
    q = counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/quillspan/{name}-{id(stream)}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_segments(spark, sf_dir):
    """The records appended by a stream as segments, read back as one index."""
    where = f"{shared_dir(spark)}/quillspan/segments-{abs(hash(sf_dir)) % 10**9}-{id(spark)}"
    records = table(spark, sf_dir, "records")
    stream = spark.readStream.schema(records.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/records.parquet") if _is_folder(spark, f"{sf_dir}/records.parquet") else spark.readStream.schema(records.schema).option("pathGlobFilter", "records.parquet").parquet(sf_dir)
    ingest.append_segments(stream, where, where + "-state").awaitTermination()
    return ingest.read_segments(spark, where).dictionary


def _is_folder(spark, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def queries() -> dict[str, Run]:
    own = [tokens, field_length, postings, dictionary, corpus_stats, host_table, doc_table, segment_ids, merged_dictionary, index_totals, position_gaps, codec_sizes, front_coding, size_report, store_summary, point_lookup, blank_texts]
    own += [url_hosts, url_tokens, url_keys, trap_reasons, registrable_domains, frontier_admission, politeness, extract_pages, crawl_rounds, robots_verdicts, robots_by_host, domain_survey]
    own += [search_rescored, score_explain, term_explain, proximity_spans, judged_search, search_snippets, host_edges, link_drop_report, in_degree_authority, trustrank_k10, authority_table, rank_correlation, top_hosts, anchor_text, anchor_report]
    own += [exact_duplicates, fingerprints, hamming_pairs, kept_pages, query_metrics, eval_summary, paired_differences, randomisation_test, ablation, stream_windows, stream_segments]
    return {n: _search(n) for n in SEARCHES} | {f.__name__: f for f in own}
