"""Index, search, links, duplicates, evaluation and streams on small corpora."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import anchors, dedupe, evaluate, frontier, index, links, query, search
from quillspan.plans import queries as plans
from quillspan.sources import store
from quillspan.streaming import ingest
from tests.conftest import rows


def record(i, url, text, title="", headings=(), links_=(), quality=(0.5, 0.0, 0, 10), final=None, fp=0):
    return (i, url, final or url, url.split("/")[2], 1_600_000_000 + i, 200, 0, fp, title, text, list(headings), "en", [tuple(x) for x in links_], quality, True, None)


def records(spark, data):
    return spark.createDataFrame(data, store.RECORD_SCHEMA)


FIVE = [
    record(0, "http://a.test/clay", "how to fire a pot in the kiln", title="clay tablets"),
    record(1, "http://b.test/x", "we saw clay and later some tablets in the museum"),
    record(2, "http://c.test/y", "clay " + "filler " * 60 + "tablets"),
    record(3, "http://farm.test/z", "clay tablets clay tablets clay tablets", quality=(0.02, 0.9, 40, 6)),
    record(4, "http://www.a.test/other", "barley and clay in the field"),
    record(5, "http://a.test/blank", "  \n "),
]


@pytest.fixture(scope="module")
def five(spark):
    return index.build(records(spark, FIVE + FIVE[:2])).stored()


def found(spark, ix, text, **options):
    hits = search.search(ix, query.literal(spark, {1: text}), search.Options(**options))
    return [r.crawl_doc for r in hits.orderBy("rank").collect()]


def test_search_forms(spark, five):
    assert found(spark, five, "clay tablets")[0] == 0 and set(found(spark, five, "clay tablets")) == {0, 1, 2, 3}
    assert found(spark, five, "clay tablets")[-1] in (2, 3)
    assert set(found(spark, five, '"clay tablets"')) == {0, 3} and found(spark, five, "clay -tablets") == [4]
    assert set(found(spark, five, 'clay -"clay tablets"')) == {1, 2, 4}
    assert set(found(spark, five, "clay site:www.a.test")) == {0, 4} and found(spark, five, "zebra clay") == [] and found(spark, five, "-clay") == []
    assert five.stats.first().n_docs == 5 and dict(rows(five.dictionary.where("term = 'clay'"))) == {"clay": 5}


def test_parts_add_up(spark, five):
    for r in search.search(five, query.literal(spark, {1: "clay tablets"}), search.Options()).collect():
        e = r.explanation
        assert r.score == pytest.approx(e.text_relevance + e.proximity + e.quality + e.authority.value, abs=1e-5)
        assert e.text_relevance == pytest.approx(sum(t.contribution for t in e.terms)) and r.matched == 4


def test_search_reads_the_postings_of_its_terms_once_for_counts_and_once_for_positions(spark, five):
    for text, term in (("clay tablets", "In(term"), ("clay", "EqualTo(term,clay)")):
        plan = search.search(five, query.literal(spark, {1: text}), search.Options())._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "/postings-" in x and "c_body" in x or "FileScan parquet" in x and "/postings-" in x and "positions" in x]
        assert len(scans) == (2 if " " in text else 1) and all(term in x for x in scans)


def test_large_batches_are_joined_and_give_the_same(spark, five, monkeypatch):
    texts = {1: "clay tablets", 2: '"clay tablets"', 3: "clay -tablets", 4: 'clay -"clay tablets"', 5: "clay site:a.test", 6: "zebra clay", 7: "-clay", 8: "clay clay", 9: 'clay -"clay zebra"', 10: "kiln"}
    run = lambda: sorted(map(str, search.search(five, query.literal(spark, texts), search.Options()).collect()))
    small = run()
    monkeypatch.setattr(search, "MOST_PARTS", 0)
    assert run() == small and small


def test_postings_of_long_and_odd_words(spark):
    text = "Ünïcode x" + "y" * 40 + " 1234567890123 123456789012 日本語 " + "w " * 3000
    ix = index.build(records(spark, [record(1, "http://a.test/1", text, title="w"), record(2, "http://a.test/2", None), record(70_000, "http://b.test/3", "w")]))
    got = {(r.term, r.crawl_doc): (r.c_body, r.c_title, r.positions) for r in ix.postings.collect()}
    assert {t for t, d in got if d == 1} >= {"ünïcode", "123456789012", "日本語", "w"} and not {t for t, _ in got if len(t) > 30 or t == "1234567890123"}
    assert got["w", 1][:2] == (3000, 1) and got["w", 1][2] == sorted(got["w", 1][2]) and got["w", 1][2][0] == 5 and got["w", 70_000] == (1, 0, [0])


def test_span_vectors(spark):
    cases = {1: ([0, 100], [95, 300], 5), 2: ([10], [11], 1), 3: ([1, 50], [51], 1), 4: ([5], [], None)}
    postings = [(f"t{k}{i}", k, p) for k, c in cases.items() for i, p in enumerate(c[:2]) if p]
    p = spark.createDataFrame(postings, "term string, crawl_doc bigint, positions array<int>")
    parts = spark.createDataFrame([(k, "term", i, 0, f"t{k}{i}") for k in cases for i in (0, 1)], query.PARTS_SCHEMA)
    docs = spark.createDataFrame([(k, k) for k in cases], "query_id bigint, crawl_doc bigint")
    assert {r.query_id: r.span for r in search.closest_spans(p, docs, parts).collect()} == {k: c[2] for k, c in cases.items()}


def test_ties_cut_segments_and_merge(spark):
    same = [record(i, f"http://h{i % 7}.test/{i}", "same words in every page of this site") for i in range(60)]
    whole = index.build(records(spark, same), anchors=False).stored()
    assert found(spark, whole, "same words", limit=12) == list(range(12))
    for size in (7, 64):
        cut = index.build(records(spark, same), anchors=False, per_segment=size)
        assert found(spark, cut, "same words", limit=12, rescore_depth=12) == list(range(12))
    halves = [index.build(records(spark, same[i::2]), anchors=False) for i in (0, 1)]
    both = index.merged(*halves)
    assert found(spark, both, "same words", limit=5) == list(range(5)) and rows(both.stats) == rows(whole.stats) and rows(both.dictionary) == rows(whole.dictionary)


def test_index_write_read_and_version(spark, five, tmp_path):
    index.write(five, f"file://{tmp_path}/ix")
    back = index.read(spark, f"file://{tmp_path}/ix")
    assert rows(back.dictionary) == rows(five.dictionary) and found(spark, back, "clay tablets") == found(spark, five, "clay tablets")
    five.stats.withColumn("format_version", F.lit(99)).write.mode("overwrite").parquet(f"file://{tmp_path}/ix/stats")
    with pytest.raises(ValueError):
        index.read(spark, f"file://{tmp_path}/ix")


def test_empty_index(spark):
    ix = index.build(records(spark, []))
    assert found(spark, ix, "clay") == [] and ix.stats.first().n_docs == 0


def test_dropped_tokens_keep_their_place(spark):
    ix = index.build(records(spark, [record(0, "http://a.test/", "one 1234567890123 two 99999999999999")]), anchors=False)
    assert {r.term: r.positions for r in ix.postings.where("term in ('one', 'two')").collect()} == {"one": [0], "two": [2]} and ix.doc_table.first().len_body == 3


def test_anchors_only_from_other_sites(spark):
    target = "http://t.test/p"
    link = lambda u, a, n=False: (u, a, n)
    data = [record(0, target, "opaque", links_=[link(target, "self praise")])]
    data += [record(1, "http://a.test/1", "x", links_=[link(target, " Clay   Guide "), link(target, "clay guide"), link(target, "hidden", True)])]
    data += [record(2, "http://sub.t.test/1", "x", links_=[link(target, "own subdomain")]), record(3, "http://b.test/1", "x", links_=[link(target, "w" * 81), link(target, "  "), link("http://gone.test/", "uncrawled")])]
    data += [record(10 + i, f"http://f{i}.test/", "x", links_=[link(target, f"phrase {i:02d}")]) for i in range(20)]
    df = records(spark, data)
    assert dict(rows(anchors.anchor_texts(df)))[0].split(" phrase")[0] == "clay guide" and dict(rows(anchors.anchor_texts(df)))[0].count("phrase") == 11
    assert dict(rows(anchors.anchor_report(df)))["repeated"] == 1
    ix = index.build(df)
    assert found(spark, ix, "clay guide") == [0]


def test_graph_votes(spark):
    link = lambda u: (u, "a", False)
    data = [record(i, f"http://one.test/{i}", "x", links_=[link("http://a.test/"), link("http://a.test/2")]) for i in range(20)]
    data += [record(30 + i, f"http://h{i}.test/", "x", links_=[link("http://www.b.test/")]) for i in range(3)]
    data += [record(40, "http://x.a.test/", "x", links_=[link("http://a.test/")])]
    df = records(spark, data)
    e = links.edges(df)
    assert {(r.src, r.dst): r.pages for r in e.collect()} == {("one.test", "a.test"): 20, **{(f"h{i}.test", "b.test"): 1 for i in range(3)}}
    assert dict(rows(links.dropped(df))) == {"counted": 23, "repeat": 20, "same_site": 1}
    d = {r.host: r.in_degree for r in links.degrees(links.hosts(df, e), e).collect()}
    assert d["a.test"] == 1 and d["b.test"] == 3


def test_trust(spark):
    e = spark.createDataFrame([("seed", "mid", 1), ("mid", "far", 9), ("orphan", "far", 1)], "src string, dst string, pages bigint")
    h = spark.createDataFrame([("seed", True), ("mid", False), ("far", False), ("orphan", False)], "host string, is_seed boolean")
    t = dict(rows(links.trust_rank(h, e)))
    assert sum(t.values()) == pytest.approx(1, abs=1e-9) and t["seed"] > t["mid"] > t["far"] > t["orphan"] == 0
    uniform = dict(rows(links.trust_rank(h.withColumn("is_seed", F.lit(False)), e, rounds=3)))
    assert sum(uniform.values()) == pytest.approx(1)
    same = spark.createDataFrame([("a", 1, 3.0), ("b", 2, 4.0), ("c", 3, 5.0)], "host string, in_degree bigint, trust double")
    assert links.rank_correlation(same, "in_degree", "trust").first().rho == 1.0 and links.rank_correlation(same.limit(1), "in_degree", "trust").first().rho is None


def test_hamming_pairs_and_greedy_keep(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 8))) for b in base for _ in range(3)]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps] + [0, None]
    r.shuffle(signed)
    df = spark.createDataFrame(list(enumerate(signed)), "crawl_doc bigint, fingerprint bigint")
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    known = sorted({f for f in signed if f})
    want = {(a, b, bits(a, b)) for a in known for b in known if a < b and bits(a, b) <= 6}
    pairs = dedupe.hamming_pairs(df)
    assert set(rows(pairs)) == want and want
    kept, out = [], {}
    for i, f in enumerate(signed):
        near = bool(f) and any(bits(f, k) <= 6 for k in kept)
        out[i] = not near
        if f and not near:
            kept.append(f)
    assert dict(rows(dedupe.keep_first(df, pairs))) == out


@pytest.fixture
def small_broadcasts(spark):
    """Tables estimated at 100 kB are broadcast, and those that turn out larger than 1 MB fail, as they do on a driver without room."""
    limits = {"spark.sql.autoBroadcastJoinThreshold": "100k", "spark.sql.maxBroadcastTableSize": "1m"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def fingerprint_rows(spark, n):
    """n random fingerprints, each followed by one that is 1 bit away."""
    r = random.Random(8)
    signed = [f - 2**63 for _ in range(n) for x in [r.getrandbits(64) | 2] for f in (x, x ^ 1)]
    return spark.createDataFrame(list(enumerate(signed)), "crawl_doc bigint, fingerprint bigint")


def test_hamming_pairs_broadcast_no_exploded_keys(spark, small_broadcasts):
    df = fingerprint_rows(spark, 1500)
    assert dedupe.hamming_pairs(df).where("distance = 1").count() == 1500
    old = df.where("crawl_doc % 2 = 0")
    assert dedupe.near_any(df, old).count() == 3000


def test_keep_first_broadcasts_no_fingerprints(spark, small_broadcasts):
    n = 6000
    docs = spark.range(2 * n).select(F.col("id").alias("crawl_doc"), (F.col("id") + 1).alias("fingerprint"))
    pairs = spark.range(n).select((2 * F.col("id") + 1).alias("a"), (2 * F.col("id") + 2).alias("b"))
    kept = dedupe.keep_first(docs, pairs).where("kept")
    assert sorted(r.crawl_doc for r in kept.collect()) == list(range(0, 2 * n, 2))


def test_metrics(spark):
    judged = spark.createDataFrame([("q", "u1", 3), ("q", "u2", 1), ("q", "u3", 0), ("none", "u9", 0)], "query string, url string, grade int")
    ranked = spark.createDataFrame([("q", 1, "u2", None), ("q", 2, "x", "u1"), ("q", 3, "zz", None)], "query string, rank int, url string, final_url string")
    m = {r.query: r for r in evaluate.metrics(ranked, judged).collect()}
    import math

    assert m["q"].ndcg == pytest.approx((1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3))) and m["q"].precision == pytest.approx(2 / 3) and m["q"].recall == 1 and m["q"].reciprocal_rank == 1 and m["q"].coverage == pytest.approx(2 / 3)
    assert m["none"].ndcg == 1 and m["none"].recall == 1 and m["none"].returned == 0
    assert evaluate.summary(evaluate.metrics(ranked, judged)).first().empty_results == 1


def test_admission_order(spark):
    rows_ = [("http://a.test/x", 1, "1"), ("http://a.test/x/", 1, "2"), ("http://a.test/y.png", 1, "3"), ("mailto:x", 1, "4"), ("http://b.test/", 9, "5"), ("http://bad.test/", 1, "6"), ("http://a.test/old", 1, "7")]
    c = spark.createDataFrame(rows_, "url string, depth int, arrival string")
    seen = spark.createDataFrame([("a.test/old",)], "key string")
    got = {r.arrival: r.refusal for r in frontier.judged(c, seen=seen, blocked=("bad.test",)).collect()}
    assert got == {"1": None, "2": "seen", "3": "extension", "4": "inadmissible", "5": "depth", "6": "blocked", "7": "seen"}


def small_web(spark, pages):
    """A fetcher of (url, text, links), and the addresses it was asked for with the second each was ready."""
    data = [(u, u.split("://")[1], "", t, [], [(x, "", False) for x in out], (True, True, True)) for u, t, out in pages]
    web = spark.createDataFrame(data, "url string, key string, title string, text string, headings array<string>, links array<struct<url:string,anchor:string,nofollow:boolean>>, directives struct<index:boolean,archive:boolean,follow:boolean>").drop("url")
    asked = []

    def fetch(todo):
        asked.append({r.key: r.ready for r in todo.collect()})
        return todo.join(web, "key")

    return fetch, asked


def test_crawl_keeps_copies_once(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = [" ".join(r.choices(words, k=300)) for _ in range(4)]
    pages = [("http://a.test/1", text[0], ["http://c.test/late"]), ("http://b.test/copy", text[0], ["http://d.test/own"]), ("http://b.test/near", text[1] + " end", []), ("http://a.test/2", text[1], [])]
    pages += [("http://c.test/late", text[1] + " stop", ["http://c.test/3"]), ("http://d.test/own", text[2], []), ("http://c.test/3", text[3], [])]
    fetch, _ = small_web(spark, pages)
    seeds = spark.createDataFrame([(u,) for u, _, _ in pages[:4]], "url string")
    kept, _ = frontier.crawl(seeds, fetch)
    # A copy is not stored, but its links are followed; one of a later round is near a page stored before.
    assert sorted(x.url for x in kept.collect()) == ["http://a.test/1", "http://a.test/2", "http://c.test/3", "http://d.test/own"]


def test_crawl_of_a_hot_host(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    pages = [(f"http://hot.test/{i}", " ".join(r.choices(words, k=200)), []) for i in range(9)] + [("http://b.test/0", " ".join(r.choices(words, k=200)), [])]
    seeds = spark.createDataFrame([(u,) for u, _, _ in pages], "url string")
    fetch, asked = small_web(spark, pages)
    kept, refused = frontier.crawl(seeds, fetch, frontier.Settings(max_per_host=7, per_host_and_round=3, delay=2.0))
    hot = [{int(k[-1]): at for k, at in a.items() if k.startswith("hot")} for a in asked]
    assert hot == [{0: 0.0, 1: 2.0, 2: 4.0}, {3: 6.0, 4: 8.0, 5: 10.0}, {6: 12.0}] and asked[0]["b.test/0"] == 0.0
    assert kept.count() == 8 and rows(refused) == [("http://hot.test/7", "host quota"), ("http://hot.test/8", "host quota")]
    first, _ = frontier.crawl(seeds, small_web(spark, pages)[0], frontier.Settings(max_pages=4, per_host_and_round=3))
    assert sorted(x.url for x in first.collect()) == ["http://b.test/0", *(f"http://hot.test/{i}" for i in range(3))]


def test_crawl_obeys_robots_of_each_host(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    urls_ = ["http://a.test/x", "http://a.test/y", "http://a.test/private/1", "http://shut.test/1", "http://failed.test/1", "http://open.test/private/2", "http://unknown.test/private/3"]
    pages = [(u, " ".join(r.choices(words, k=200)), []) for u in urls_]
    answers = [("a.test", 200, "User-agent: *\nDisallow: /private/\nCrawl-delay: 9"), ("www.shut.test", 403, None), ("failed.test", 500, None), ("open.test", 404, None), ("a.test", 200, "User-agent: *\nDisallow: /private/\nCrawl-delay: 9")]
    fetch, asked = small_web(spark, pages)
    seeds = spark.createDataFrame([(u,) for u in urls_], "url string")
    kept, refused = frontier.crawl(seeds, fetch, frontier.Settings(delay=2.0), spark.createDataFrame(answers, "host string, status int, body string"))
    assert sorted(x.url for x in kept.collect()) == ["http://a.test/x", "http://a.test/y", "http://open.test/private/2", "http://unknown.test/private/3"]
    assert sorted(rows(refused)) == [(u, "robots") for u in ("http://a.test/private/1", "http://failed.test/1", "http://shut.test/1")]
    assert asked[0]["a.test/x"] == 0.0 and asked[0]["a.test/y"] == 9.0


def test_crawl_rounds_begin_at_every_page_of_depth_0(spark, tmp_path):
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    data = [record(100 + i, f"http://h{i}.test/", " ".join(r.choices(words, k=200))) for i in range(14)]
    records(spark, data).write.parquet(f"file://{tmp_path}/records.parquet")
    assert rows(plans.crawl_rounds(spark, f"file://{tmp_path}")) == [(0, 14, 14)]


def test_store_round_trip_and_version(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    s = store.write_store(records(spark, FIVE), path).first()
    assert s.pages == 6 and s.by_status == {200: 6} and store.open_store(spark, path).count() == 6
    assert store.lookup(store.open_store(spark, path), spark.createDataFrame([(3,)], "crawl_doc bigint")).first().url == "http://farm.test/z"
    records(spark, FIVE[:1]).withColumn("format_version", F.lit(9)).write.mode("append").parquet(f"{path}/records")
    with pytest.raises(store.StoreError):
        store.open_store(spark, path)


def test_streamed_segments_equal_one_build(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    records(spark, FIVE).repartition(3).write.parquet(folder)
    stream = ingest.seen_once(ingest.record_stream(spark, folder, 1)).drop("key", "at")
    ingest.append_segments(stream, f"file://{tmp_path}/ix", f"file://{tmp_path}/state").awaitTermination()
    back = ingest.read_segments(spark, f"file://{tmp_path}/ix")
    assert rows(back.dictionary) == rows(index.build(records(spark, FIVE), anchors=False).dictionary)


def test_polite_turns(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    spark.createDataFrame([("http://a.test/1", 10), ("http://a.test/2", 10), ("http://b.test/1", 5)], "url string, fetched_at bigint").write.parquet(folder)
    stream = spark.readStream.schema("url string, fetched_at bigint").parquet(folder)
    ingest.polite(stream, 3.0).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.host, r.ready) for r in spark.table("turns").collect()) == [("a.test", 10.0), ("a.test", 13.0), ("b.test", 5.0)]


def test_entry_has_sql_for_names_only():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
