"""python -m quillspan.cli VERB: crawl, index, merge, link, eval, search, serve.

Stores and indexes are folders of Parquet tables. There is no network: ``crawl`` reads
the pages of a table (url, html) as if they were the web, and ``serve`` answers on a
local address from one session.
"""

from __future__ import annotations

import argparse
from html import escape
from urllib.parse import parse_qs, quote_plus, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html, urls
from .functions.snippets import snippet
from .functions.text import human_bytes
from .operators import evaluate, frontier, index, links, query, search
from .sources import store

MOST_QUERY_CHARS, MOST_SEARCHES, BUSY_RETRY = 512, 8, 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspan")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, **flags):
        v = verbs.add_parser(name)
        for flag, default in flags.items():
            option = "--" + flag.replace("_", "-")
            if default is bool:
                v.add_argument(option, action="store_true")
            elif default is str:
                v.add_argument(option, required=True)
            else:
                v.add_argument(option, default=default, type=type(default) if default is not None else str)
        return v

    verb("crawl", seeds=str, pages=str, out=str, max_pages=1000, delay=3.0, max_depth=4, max_per_host=5000, near_bits=0, user_agent="quillspan", quiet=bool)
    verb("index", crawl=str, out=str, docs_per_segment=50_000, quiet=bool)
    verb("merge", index=str, other=str, out=str, docs_per_segment=1_000_000, quiet=bool)
    verb("link", crawl=str, seeds=None, out=None, method="in-degree", damping=0.85, top=20)
    verb("eval", judgments=str, index=str, crawl=str, authority=None, depth=10, without=None, compare_authority=bool, per_query=bool)
    verb("search", index=str, crawl=str, authority=None, limit=10, explain=bool).add_argument("query", nargs="+")
    verb("serve", index=str, crawl=str, authority=None, address="127.0.0.1:8080", limit=10, explain=bool, max_concurrent_searches=MOST_SEARCHES)
    return p


def read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def run_crawl(spark: SparkSession, a) -> str:
    web = spark.read.parquet(a.pages).select(urls.dedupe_key(urls.normal_url(F.col("url"))).alias("key"), "html").where("key is not null").dropDuplicates(["key"])
    seeds = spark.createDataFrame([(s,) for s in store.parse_seeds(read(a.seeds))], "url string")

    def fetch(todo: DataFrame) -> DataFrame:
        pages = todo.join(web, "key")
        return pages.select("key", "depth", "host").join(html.extract(pages, "key", "url", "html"), "key").drop("canonical")

    kept, refused = frontier.crawl(seeds, fetch, frontier.Settings(max_pages=a.max_pages, max_depth=a.max_depth, max_per_host=a.max_per_host, delay=a.delay, near_bits=a.near_bits))
    records = kept.select(F.xxhash64("url").bitwiseAND(F.lit(2**62 - 1)).alias("crawl_doc"), "url", F.col("url").alias("final_url"), "host", F.lit(None).cast("bigint").alias("fetched_at"), F.lit(200).alias("status"), "depth", "fingerprint", "title", "text", "headings", "lang", "links", "quality", F.col("directives.snippet").alias("snippet_allowed"), F.col("directives.max_snippet").alias("max_snippet"))
    made = store.write_store(records, a.out).first()
    return f"{made.pages} pages of {made.hosts} hosts, {human_bytes(made.text_bytes or 0)} of text; refused: {dict((r.refusal, r.candidates) for r in frontier.refusals(refused).collect())}"


def run_index(spark: SparkSession, a) -> str:
    made = index.build(store.open_store(spark, a.crawl), per_segment=a.docs_per_segment).stored()
    index.write(made, a.out)
    return report(made)


def run_merge(spark: SparkSession, a) -> str:
    if a.out in (a.index, a.other):
        raise SystemExit("merge writes to a folder of its own")
    made = index.merged(index.read(spark, a.index), index.read(spark, a.other), a.docs_per_segment)
    index.write(made, a.out)
    return report(index.read(spark, a.out))


def report(ix: index.Index) -> str:
    t = index.totals(ix).first()
    return f"{t.documents} documents, {t.terms} terms, {t.postings} postings, {t.positions} positions"


def run_link(spark: SparkSession, a) -> str:
    docs = index.crawl_docs(store.open_store(spark, a.crawl))
    seeds = [h for s in (store.parse_seeds(read(a.seeds)) if a.seeds else []) if (h := store.host_from(s))]
    links.write_authority(links.authority(docs, seeds, a.damping), a.out or f"{a.crawl}/authority")
    table = links.read_authority(spark, a.out or f"{a.crawl}/authority")
    measure = "in_degree" if a.method == "in-degree" else "trust"
    rho = links.rank_correlation(table, "in_degree", "trust").first().rho
    best = table.orderBy(F.desc(measure), "host").limit(a.top).collect()
    return "\n".join([f"{r.host}\t{r[measure]}" for r in best] + [f"rank correlation of both measures: {rho}"])


def loaded(spark: SparkSession, a) -> tuple[index.Index, DataFrame | None]:
    return index.read(spark, a.index), links.read_authority(spark, a.authority or f"{a.crawl}/authority")


def weights_without(name: str | None) -> tuple[search.Weights, bool]:
    """Weights with one signal off, and whether authority stays."""
    off = {None: {}, "proximity": {"proximity": 0.0}, "quality": {"quality": 0.0}, "anchor": {"anchor": 0.0}, "authority": {}}
    return search.Weights(**off[name]), name != "authority"


def run_eval(spark: SparkSession, a) -> str:
    ix, table = loaded(spark, a)
    judged = evaluate.clean_judgments(store.judgments(spark, read(a.judgments)))
    named = evaluate.numbered_queries(judged)
    docs = index.crawl_docs(store.open_store(spark, a.crawl)).select("crawl_doc", "url", "final_url")

    def measured(w: search.Weights, authority: DataFrame | None, factor: str = "factor_indegree") -> DataFrame:
        hits = search.search(ix, query.parsed(named), search.Options(limit=a.depth, weights=w), authority, factor)
        return evaluate.metrics(docs.join(hits, "crawl_doc").join(named.withColumnRenamed("text", "query"), "query_id"), judged, a.depth)

    base = measured(search.Weights(), table)
    s = evaluate.summary(base).first().asDict()
    out = [", ".join(f"{k} {v:.4f}" for k, v in s.items() if k in evaluate.MEASURES), *evaluate.notes(s, table is not None)]
    if a.without:
        w, keep = weights_without(a.without)
        out.append(f"without {a.without}: " + evaluate.compare(spark, measured(w, table if keep else None), base).first().verdict)
    if a.compare_authority and table is not None:
        out.append("trust against in-degree: " + evaluate.compare(spark, base, measured(search.Weights(), table, "factor_trust")).first().verdict)
    if a.per_query:
        out += [f"{r.ndcg:.4f}\t{r.query}" for r in base.orderBy("ndcg", "query").collect()]
    return "\n".join(out)


def answers(spark: SparkSession, ix, table, crawl: str, text: str, limit: int) -> list[dict]:
    """The hits of one query with titles, addresses and extracts; at most ``limit`` rows reach the driver."""
    q = query.parse(text[:MOST_QUERY_CHARS])
    if q.empty:
        return []
    hits = search.search(ix, query.literal(spark, {1: text[:MOST_QUERY_CHARS]}), search.Options(limit=limit), table)
    rows = search.with_records(hits, store.open_store(spark, crawl)).orderBy("rank").collect()
    return [r.asDict(True) | dict(zip(("extract", "marks"), snippet(r.text, q.terms, r.snippet_allowed is not False, r.max_snippet))) for r in rows]


def run_search(spark: SparkSession, a) -> str:
    ix, table = loaded(spark, a)
    out = []
    for r in answers(spark, ix, table, a.crawl, " ".join(a.query), a.limit):
        out.append(f"{r['rank']}. {r['title'] or r['url']}  {r['score']:.4f}\n   {r['url']}\n   {r['extract']}")
        if a.explain:
            e = r["explanation"]
            out.append(f"   relevance {e['text_relevance']:.4f}, proximity {e['proximity']:.4f} (span {e['closest_span']}), authority {e['authority']['value']:.4f}, quality {e['quality']:.4f}")
    return "\n".join(out) or "no results"


def page(title: str, body: str) -> str:
    return f"<!doctype html><html lang=en><meta charset=utf-8><title>{escape(title)}</title><body><form action=/search><input name=q value=\"{escape(title, quote=True)}\"><button>Search</button></form>{body}</body></html>"


def results_page(text: str, rows: list[dict]) -> str:
    items = "".join(f'<li><a href="{escape(r["url"], quote=True)}">{escape(r["title"] or r["url"])}</a><p>{html.marked(r["extract"], r["marks"])}</p>' for r in rows)
    return page(text, f"<ol>{items}</ol>" if rows else f"<p>Nothing holds all of these words. <a href=\"/search?q={quote_plus(text)}\">Try again</a></p>")


def run_serve(spark: SparkSession, a) -> str:
    """Routes: /, /search?q=, /privacy, /crawler. Searches beyond the permitted number are turned away at once; queries are never logged."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    ix, table = loaded(spark, a)
    permits = threading.Semaphore(a.max_concurrent_searches)
    fixed = {"/": page("", ""), "/privacy": page("", "<p>Queries are not stored.</p>"), "/crawler": page("", f"<p>The crawler calls itself {html.CRAWLER} and keeps to robots.txt.</p>")}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, status: int, body: str, **headers):
            self.send_response(status)
            for k, v in ({"Content-Type": "text/html; charset=utf-8"} | headers).items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(body.encode())

        def do_GET(self):
            url = urlsplit(self.path)
            if url.path in fixed:
                return self.reply(200, fixed[url.path])
            if url.path != "/search":
                return self.reply(404, page("", "<p>No such page.</p>"))
            if not permits.acquire(blocking=False):
                return self.reply(503, page("", "<p>Busy.</p>"), Retry_After=str(BUSY_RETRY))
            try:
                text = parse_qs(url.query).get("q", [""])[0]
                self.reply(200, results_page(text, answers(spark, ix, table, a.crawl, text, a.limit)))
            finally:
                permits.release()

    host, _, port = a.address.rpartition(":")
    ThreadingHTTPServer((host, int(port)), Handler).serve_forever()
    return ""


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("quillspan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(globals()[f"run_{a.verb}"](spark, a))


if __name__ == "__main__":
    main()
