import pytest

from quillspan import cli
from quillspan.functions import udtf


def test_flags():
    a = cli.parser().parse_args(["search", "--index", "i", "--crawl", "c", "old", "river"])
    assert a.query == ["old", "river"] and a.limit == 10 and not a.explain
    assert cli.parser().parse_args(["link", "--crawl", "c"]).damping == 0.85
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["index"])


def test_from_crawl_to_answers(spark, tmp_path, capsys):
    words = "the kiln and the clay of the old river tablets " * 6
    pages = [("http://a.test/", f"<title>home</title><article><p>{words}<p><a href='http://b.test/x'>clay guide</a></article>"), ("http://b.test/x", f"<title>guide to clay</title><article><p>{words} barley</article>"), ("http://b.test/hidden", "<meta name=robots content=noindex><p>secret")]
    spark.createDataFrame(pages, "url string, html string").write.parquet(f"{tmp_path}/pages")
    (tmp_path / "seeds").write_text("# seeds\nhttp://a.test/\nhttp://b.test/hidden\n")
    (tmp_path / "judgments").write_text("query: clay barley\n3 http://b.test/x\n")
    crawl, ix = f"{tmp_path}/crawl", f"{tmp_path}/index"
    cli.main(["crawl", "--seeds", f"{tmp_path}/seeds", "--pages", f"{tmp_path}/pages", "--out", crawl])
    assert "2 pages of 2 hosts" in capsys.readouterr().out
    cli.main(["index", "--crawl", crawl, "--out", ix])
    assert "2 documents" in capsys.readouterr().out
    cli.main(["link", "--crawl", crawl, "--seeds", f"{tmp_path}/seeds"])
    assert capsys.readouterr().out.splitlines()[0] == "b.test\t1"
    cli.main(["search", "--index", ix, "--crawl", crawl, "--explain", "clay", "guide"])
    out = capsys.readouterr().out
    assert "guide to clay" in out and "relevance" in out
    cli.main(["eval", "--judgments", f"{tmp_path}/judgments", "--index", ix, "--crawl", crawl])
    assert "ndcg 1.0000" in capsys.readouterr().out
    rows = [{"url": "http://a.test/?a=1&b=2", "title": "<b>", "extract": "a <i>", "marks": [(0, 1)]}]
    shown = cli.results_page('x"y', rows)
    assert "&lt;b&gt;" in shown and "<mark>a</mark> &lt;i&gt;" in shown and "<script" not in shown


def test_table_function(spark):
    udtf.register(spark)
    assert [tuple(r) for r in spark.sql("select * from tokenize('One 1234567890123 Two')").collect()] == [(0, "one"), (2, "two")]
