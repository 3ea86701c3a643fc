"""Pure functions: query language, addresses, robots, pages, snippets, codecs, judgments."""

import random

import pytest

from quillspan.functions import codecs, html, robots, simhash, snippets, text, urls
from quillspan.operators import evaluate, links, query
from quillspan.sources import store


def test_query_language():
    q = query.parse('clay tablets "old river" -barley -"dry well" site:WWW.A.test')
    assert q.required == ["clay", "tablets", "old", "river"] and q.phrases == [["old", "river"]]
    assert q.excluded == ["barley"] and q.excluded_phrases == [["dry", "well"]] and q.site == "a.test"
    assert query.parse('clay"tablets"').required == ["claytablets"]
    assert query.parse("well-known").phrases == [["well", "known"]]
    assert query.parse('"open quote runs').phrases == [["open", "quote", "runs"]]
    assert query.parse('""').empty and query.parse("-only site:a.test").empty
    assert query.parse('"site:a.test"').site is None and query.parse("-site:a.test").excluded_phrases == [["site", "a", "test"]]
    assert query.parse("a site:x.test site:y.test").site == "y.test"
    assert query.parse("x" * 41 + " 1234567890123 ok").required == ["ok"]
    assert query.parse("b a b").terms == ["b", "a"]


def test_addresses():
    assert urls.normalise("HTTP://Host.TEST:80/a?utm_source=x&b=1#f") == "http://host.test/a?b=1"
    assert urls.normalise("ftp://a.test/") is None and urls.normalise("http:///x") is None and urls.normalise("http://a.test/" + "x" * 2048) is None
    assert urls.resolve("http://a.test/b/c", "../d?sid=1") == "http://a.test/d" and urls.resolve("http://a.test/", "#top") is None and urls.resolve("http://a.test/", "mailto:x@y") is None


@pytest.mark.parametrize("host,want", [("www.example.com", "example.com"), ("a.b.co.uk", "b.co.uk"), ("x.github.io", "x.github.io"), ("a.b.ck", "a.b.ck"), ("www.ck", "www.ck"), ("a.www.ck", "www.ck"), ("deep.host.unknown", "host.unknown"), ("127.0.0.1", "127.0.0.1"), ("com", "com"), (None, None)])
def test_registrable(host, want):
    assert urls.registrable(host) == want


def test_address_columns(spark):
    data = ["https://Www.A.test:443/x/?utm_id=1&b=2&a=1#f", "http://u:p@b.test:8080/", "http://a.test", "ftp://a.test/", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(data)], "i int, u string").select("i", urls.normal_url(text.F.col("u")).alias("n"))
    got = {r.i: (r.n, r.k, r.h) for r in df.select("i", "n", urls.dedupe_key(text.F.col("n")).alias("k"), urls.host_node(text.F.col("n")).alias("h")).collect()}
    assert got[0] == ("https://www.a.test/x/?b=2&a=1", "www.a.test/x?a=1&b=2", "a.test") and got[2][0] == "http://a.test/" and got[3][0] is None and got[4][0] is None


@pytest.mark.parametrize("url,depth,of_host,want", [("http://a.test/x", 5, 0, "depth"), ("http://a.test/x", 1, 5000, "host quota"), ("http://a.test/" + "a/" * 13, 1, 0, "segments"), ("http://a.test/?a&b&c&d&e", 1, 0, "parameters"), ("http://a.test/x.PNG", 1, 0, "extension"), ("http://a.test/ab/ab/ab/ab", 1, 0, "repetition"), ("http://a.test/2150/1", 1, 0, "date"), ("http://a.test/2021/ab/ab/ab", 4, 4999, None)])
def test_traps(spark, url, depth, of_host, want):
    assert spark.range(1).select(urls.trap(*map(text.F.lit, (url, depth, of_host)))).first()[0] == want


def test_robots():
    r = robots.parse("User-agent: quill\nUser-agent: other\nDisallow: /a/\nAllow: /a/*.html$\nCrawl-delay: 9999\n\nUser-agent: *\nDisallow: /\nSitemap: http://a.test/s.xml # x")
    assert r["sitemaps"] == ["http://a.test/s.xml"] and robots.group_for(r, "quillspan")["delay"] == 3600
    assert robots.allows(r, "quillspan", "/a/b.html") and not robots.allows(r, "quillspan", "/a/b.html?x") and robots.allows(r, "quillspan", "/b")
    assert not robots.allows(r, "nobody", "/b") and robots.allows(robots.parse(""), "x", "/")
    assert robots.allows(robots.parse("User-agent: *\nDisallow: /ab\nAllow: /ab"), "x", "/ab")


def test_robots_over_rows(spark):
    df = spark.createDataFrame([("User-agent: *\nDisallow: /x", "/x/1"), ("User-agent: *\nDisallow: /x", "/y"), (None, "/x")], "b string, p string")
    assert [r[0] for r in df.coalesce(1).select(robots.allowed("q")("b", "p")).collect()] == [False, True, True]


PAGE = """<html lang="EN"><head><title> A  title </title><meta name=robots content="nofollow, max-snippet:50"><link rel=canonical href="/c?utm_source=1">
<script>x</script></head><body><div class="nav-bar menu">skip me</div><article><h1>Head</h1><p>{words}<p>second &amp; last <a href="/in?a=1" rel="nofollow">a link</a>
<ul><li>one<li>two</ul><a href="/in?a=1">again</a></article><footer>foot</footer></body></html>"""


def test_page_extraction():
    p = html.page(PAGE.replace("{words}", "word " * 40), "http://a.test/x/")
    assert p["title"] == "A title" and p["lang"] == "en" and p["canonical"] == "http://a.test/c" and p["headings"] == ["Head"]
    assert p["links"] == [{"url": "http://a.test/in?a=1", "anchor": "a link", "nofollow": True}]
    assert "skip me" not in p["text"] and "foot" not in p["text"] and "second & last a link" in p["text"] and "one\ntwo" in p["text"]
    assert p["directives"] == {"index": True, "follow": False, "archive": True, "snippet": True, "max_snippet": 50} and p["quality"]["scripts"] == 1
    empty = html.page("", "http://a.test/")
    assert empty["text"] == "" and empty["quality"]["text_ratio"] == 0.0
    assert html.directives(["none"])["index"] is False and html.squeeze(" a \t b\r\n c ") == "a b\nc"


def test_pages_over_rows(spark):
    df = spark.createDataFrame([(1, "http://a.test/", PAGE), (2, "http://a.test/", None)], "k bigint, u string, h string")
    got = {r.k: r for r in html.extract(df, "k", "u", "h").collect()}
    assert got[1].title == "A title" and got[2].text == "" and got[2].links == []


def test_snippets():
    body = "start " + "filler words here " * 40 + "the needle and the thread " + "more words after " * 40
    s, marks = snippets.snippet(body, ["needle", "thread"])
    assert s.startswith("…") and s.endswith("…") and [s[a:z] for a, z in marks] == ["needle", "thread"]
    assert snippets.snippet(body, ["x"], allowed=False) == ("", []) and snippets.snippet("  ", ["x"]) == ("", []) and snippets.snippet(body, ["x"], most=0) == ("", [])
    assert len(snippets.snippet(body, ["needle"], most=30)[0]) < 120 and snippets.snippet("short text", ["none"])[0] == "short text"
    assert html.marked("a <b> c", [(2, 5)]) == "a <mark>&lt;b&gt;</mark> c"


@pytest.mark.parametrize("name", codecs.CODECS)
def test_codecs_round_trip_and_refuse_damage(name):
    enc, dec = codecs.CODECS[name]
    r = random.Random(1)
    for values in ([], [0], [2**32 - 1] * 3, [r.choice([0, 1, 5, 200, 2**20, 2**31]) for _ in range(1000)], list(range(128)), [1] * 129):
        data = enc(values)
        assert dec(data, len(values)) == values
        if len(values) > 1 and data:
            with pytest.raises(codecs.Corrupt):
                dec(data[: len(data) // 2], len(values))
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(0, 9))) for _ in range(200)})
    assert codecs.front_decode(codecs.front_encode(words), len(words)) == words and codecs.from_gaps(codecs.gaps([3, 9, 20])) == [3, 9, 20]


def test_fingerprints():
    essay = " ".join(f"word{i % 97} turns{i % 31}" for i in range(200))
    near = simhash.fingerprint(essay + " and one more sentence at the end")
    far = simhash.fingerprint(" ".join(f"other{i % 83} thing{i % 29}" for i in range(200)))
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0 and bits(simhash.fingerprint(essay), near) <= 6 < 15 < bits(simhash.fingerprint(essay), far)
    assert int(simhash.fnv1a([b"a"])[0]) == 0xAF63DC4C8601EC8C and int(simhash.fnv1a([b""])[0]) == 0xCBF29CE484222325


def test_judgments_and_seeds():
    assert evaluate.parse_judgments("# c\nquery: a b\n3 http://x\n0 http://y") == [("a b", "http://x", 3), ("a b", "http://y", 0)]
    for bad in ("3 http://x", "query: a\n4 http://x", "query: a\n3", "query: a\n1 http://x\n2 http://x", "query: a"):
        with pytest.raises(evaluate.JudgmentError):
            evaluate.parse_judgments(bad)
    assert store.parse_seeds("# c\nhttp://a.test # x\n") == ["http://a.test/"]
    for bad in ("", "nonsense"):
        with pytest.raises(store.StoreError):
            store.parse_seeds(bad)


def test_randomisation():
    small = evaluate.randomisation_test([0.1] * 5, trials=500)
    strong = evaluate.randomisation_test([0.3] * 30, trials=500)
    none = evaluate.randomisation_test([0.1, -0.1] * 15, trials=500)
    assert "smoke" in small["verdict"] and strong["p"] < 0.01 and "better" in strong["verdict"] and none["p"] > 0.5 and none["better"] == none["worse"] == 15
    assert links.rounds_needed() == 133


def test_decoding_bodies():
    assert store.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é" and store.decode(b'<meta charset="windows-1252">\x80') == '<meta charset="windows-1252">€'
    assert store.decode("é".encode()) == "é" and store.decode(b"\xef\xbb\xbfx") == "x" and store.decode(None) is None
    assert text.human_bytes(512) == "512 B" and text.human_bytes(2048) == "2.0 KiB"


def test_tallies_of_deep_nesting_equal_those_of_each_element_alone():
    import time

    page = "<body>" + "<div>two words" * 40 + "<a href=x>a link here</a><div class='nav'>menu</div>" + "</div>" * 40
    root = html.tree(page)
    counts = html.tallies(root)
    for n in root.walk():
        inner = [x for x in n.walk() if x is not n]
        links = sum(len(x.text().split()) for x in [n, *inner] if x.tag == "a" and "href" in x.attrs)
        assert counts[id(n)] == (len(html.article_text(n).split()), links, sum(map(html.is_candidate, inner)))
    began = time.time()
    html.article(html.tree("<body>" + "<div>two words" * 4000))
    assert time.time() - began < 5


def test_densest_stretch_equals_brute_force():
    import random

    from quillspan.functions.snippets import densest

    r = random.Random(3)
    for _ in range(200):
        found, at = [], 0
        for _ in range(r.randint(1, 12)):
            at += r.randint(0, 30)
            found.append((at, at + 3, r.choice("abc")))
            at += 3
        size, budget = at + r.randint(0, 40), r.randint(5, 60)
        spans = [(max(0, s - budget // 4), min(max(0, s - budget // 4) + budget, size)) for s, _, _ in found]
        shown = [len({t for s, e, t in found if s >= a and e <= z}) for a, z in spans]
        assert densest(found, size, budget) == spans[shown.index(max(shown))]
