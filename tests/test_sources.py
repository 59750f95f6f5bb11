"""Readers against small documents and files."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fathomline import sources
from fathomline.sources import feeds, market

RSS = """<rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:prism="http://prismstandard.org/namespaces/basic/2.0/"><channel>{}</channel></rss>"""


def one(spark, text, name="feed", **more):
    return spark.createDataFrame([(text, *more.values())], f"{name} string" + "".join(f", {k} string" for k in more))


def test_nber(spark):
    item = "<item><title>A &amp;amp; B</title><link>https://www.nber.org/papers/W123#x</link><guid>g</guid><description>by Ann A, Bob B - 2026-05-09 - The &lt;b&gt;text&lt;/b&gt; - more</description></item><item><title>C</title><link>x</link><guid>g2</guid><description>Plain</description></item>"
    a, b = feeds.nber(one(spark, RSS.format(item))).collect()
    assert (a.source_id, a.title, a.authors, a.abstract, a.pdf_url) == ("w123", "A & B", ["Ann A", "Bob B"], "The text - more", "https://www.nber.org/papers/w123.pdf")
    assert (b.source_id, b.authors, b.abstract, b.pdf_url) == ("g2", [], "Plain", "")
    assert feeds.nber(one(spark, "no xml")).isEmpty() and feeds.nber(one(spark, None)).isEmpty()


def test_fed_and_wiley(spark):
    a = feeds.fed(one(spark, RSS.format("<item><title>T</title><guid>z</guid><description>FEDS 2024-012: words</description></item>"))).first()
    assert (a.source_id, a.categories) == ("2024-012", ["fed:FEDS"])
    item = "<item><title>T</title><link>l</link><prism:doi>doi:10.1/x</prism:doi><dc:creator>Ann A, Bob B</dc:creator></item><item><title>U</title><link>l2</link><guid>n</guid><dc:creator>A</dc:creator><dc:creator>B</dc:creator></item>"
    x, y = feeds.wiley(one(spark, RSS.format(item), jc="FUT"), journal="jc").collect()
    assert (x.source_id, x.doi, x.authors, x.categories) == ("10.1/x", "10.1/x", ["Ann A", "Bob B"], ["wiley:FUT"]) and (y.source_id, y.authors) == ("l2", ["A", "B"])


def test_ssrn_falls_back_to_pages(spark):
    fs = spark.createDataFrame([("1", RSS.format("<item><title>T</title><link>h?abstract_id=77</link></item>")), ("2", "blocked")], "journal string, feed string")
    ps = spark.createDataFrame([("1", "<a href='?abstract_id=1'>Not used</a>"), ("2", "<a href='x?abstract_id=88'>Two <b>words</b></a><a href='x?abstract_id=9'></a><a href='y'>No id</a>")], "journal string, html string")
    assert sorted((r.source_id, r.title) for r in feeds.ssrn(fs, ps).collect()) == [("77", "T"), ("88", "Two words")]


def test_aqr_and_repec(spark):
    page = "<a href='/Insights/Research/'>All research</a><a href='/Insights/Research/White-Papers/A-Title'>A long title</a><a href='/Insights/Research/White-Papers/A-Title'>Again that one</a><a href='/Insights/Research/White-Papers/B'>Tiny</a>"
    got = feeds.aqr(one(spark, page, "html")).collect()
    assert [(r.source_id, r.title, r.categories) for r in got] == [("/Insights/Research/White-Papers/A-Title", "A long title", ["aqr:White Papers"])]
    page = """<div id="p1"><a href="http://d.repec.org/n?u=RePEc:abc:wpaper:12&r=fmk">Some <i>title</i></a></div><table class="basit"><tr><td>By:</td><td>Doe, J; Roe, R</td></tr><tr><td>Abstract:</td><td>Text</td></tr><tr><td>JEL:</td><td>G12 toolong G1</td></tr><tr><td>Date:</td><td>2024–05</td></tr></table>
    <div id="p2"><a href="x">No id</a></div><div id="px"><a href="RePEc:abc:wpaper:1">Not a paper</a></div>"""
    r = feeds.repec(one(spark, page, "html", topic="fmk")).collect()
    assert [(x.source_id, x.title, x.authors, x.abstract, x.published, x.categories) for x in r] == [("RePEc:abc:wpaper:12", "Some title", ["Doe, J", "Roe, R"], "Text", "2024-05-01", ["nep:fmk", "jel:G12", "jel:G1"])]


def test_atom(spark):
    text = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2605.01300v2</id><title>A\n title</title><summary>S</summary><author><name>N</name></author><category term="q-fin"/><link type="application/pdf" href="p"/></entry></feed>'
    r = sources.atom(one(spark, text), "feed").first()
    assert (r.source_id, r.title, r.authors, r.pdf_url) == ("2605.01300", "A title", ["N"], "p")


def test_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in sources.ledger(spark, str(tmp_path / "l.jsonl"), "a int").collect() if r.a is not None) == [1, 2]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        sources.ledger(spark, str(tmp_path / "l.jsonl"), "a int", strict=True).collect()
    (tmp_path / "o.csv").write_text("date,weight\n2024-01-01,1.5\n2024-01-02,-1\n")
    assert [r.weight for r in market.overlay(spark, str(tmp_path / "o.csv")).orderBy("date").collect()] == [1, 0]
    spark.range(5).selectExpr("id", "date_add(date '2024-01-01', cast(id as int)) d").write.parquet(str(tmp_path / "p"))
    assert sources.parquet(spark, str(tmp_path / "p"), ["id"], "d", "2024-01-02", "2024-01-03").count() == 2


def test_guards_years_and_caches(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None)], "close double, adj_close double")
    with pytest.raises(ValueError, match="adjusted"):
        market.stock_bars(df, columns=("close",))
    assert "adj_close" in market.stock_bars(df, otherwise="raw", columns=("close",)).columns
    assert [r.close for r in market.stock_bars(df, otherwise="keep", columns=("close",)).collect()] == [2.0, None]
    days = spark.createDataFrame([("2022-03-01",), ("2024-02-01",)], "d string")
    asked = []
    got = market.by_year(lambda a, b: asked.append((a, b)) or days.where(F.col("d").between(a, b)), "2022-02-01", "2024-06-30")
    assert got.count() == 2 and asked == [("2022-02-01", "2022-12-31"), ("2023-01-01", "2023-12-31"), ("2024-01-01", "2024-06-30")]
    spark.range(3).createOrReplaceTempView("cached_source")
    assert market.cached(spark, str(tmp_path), "select * from cached_source").count() == 3
    spark.range(9).createOrReplaceTempView("cached_source")
    assert market.cached(spark, str(tmp_path), "select * from cached_source").count() == 3
    assert market.cached(spark, str(tmp_path), "select * from cached_source", refresh=True).count() == 9
    assert market.catalog(spark).where("name = 'cached_source'").first().type == "bigint"
    rates = {r.year: r.null_rate for r in market.null_rates(days.select(F.to_date("d").alias("d"), F.when(F.col("d") < "2023", 1).alias("x")), "x", "d").collect()}
    assert rates == {2022: 0.0, 2024: 1.0, None: 0.5}


def test_synthetic_bars_repeat(spark):
    a, b = (market.synthetic_bars(spark, ["x", "y"], 50, 3).orderBy("symbol", "ts").collect() for _ in range(2))
    assert a == b and len(a) == 100 and all(r.low <= min(r.open, r.close) and r.high >= max(r.open, r.close) for r in a)
    f = market.synthetic_futures(spark, 2, 3).where("sid = 1 and t = 2").first()
    assert f.close == pytest.approx(1e4 * math.exp(0.0006 + 0.1 * math.sin(2 / 74) + 0.012 * math.sin(2 / 3)) + 2)
