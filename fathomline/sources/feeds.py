"""Feeds and listing pages, one document a row, to rows of papers.

Markup is taken apart by one extractor for feeds and one for pages, in Arrow batches; what a source makes of an entry is
a Column expression. Columns out: source, source_id, title, authors, abstract, published, url, pdf_url, categories, doi.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ENTRY = "id string, title string, link string, summary string, published string, creators array<string>, prism_doi string, cover_date string"
#: Names of a feed's elements: field -> local names, the first that is there counts.
FIELDS = {"id": ("id", "guid"), "title": ("title",), "summary": ("description", "summary"), "published": ("pubDate", "published", "date"), "prism_doi": ("doi",), "cover_date": ("coverDate", "coverdate")}


def _text(s: str | None) -> str:
    return " ".join((s or "").split())


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


def plain(markup: str | None) -> str:
    """The text of a piece of markup, its parts one space apart."""
    p = _Plain()
    p.feed(markup or "")
    p.close()
    return _text(" ".join(p.parts))


def read_entries(feed: str | None) -> list[tuple]:
    """Entries of an RSS or Atom feed; a feed that is no XML has none."""
    try:
        root = ET.fromstring(feed or "")
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for e in (x for x in root.iter() if local(x) in ("item", "entry")):
        held: dict[str, list] = {}
        for c in e:
            held.setdefault(local(c), []).append(c)
        first = lambda names: next((_text(held[n][0].text) for n in names if n in held), "")
        links = held.get("link", [])
        link = next((_text(x.text) or x.get("href") or "" for x in links), "")
        names = [_text(x.text) for x in held.get("creator", [])] + [_text(n.text) for a in held.get("author", []) for n in ([c for c in a if local(c) == "name"] or [a])]
        f = {k: first(v) for k, v in FIELDS.items()}
        out.append((f["id"], plain(f["title"]), link, plain(f["summary"]), f["published"] or None, [n for n in names if n], f["prism_doi"], f["cover_date"]))
    return out


def _each(df: DataFrame, column: str, read, schema: str, keep: list[str]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(*(getattr(r, k) for k in keep), *x) for r in pdf.itertuples(index=False) for x in read(getattr(r, column))]
            yield pd.DataFrame(rows, columns=[*keep, *names])

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, column).mapInPandas(run, f"{types}, {schema}" if types else schema)


def entries(df: DataFrame, column: str = "feed", keep: list[str] | None = None) -> DataFrame:
    return _each(df, column, read_entries, ENTRY, keep or [])


def _paper(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    none = {"authors": F.array().cast("array<string>"), "abstract": F.col("summary"), "published": F.col("published"), "url": F.col("link"), "pdf_url": F.lit(""), "categories": F.array().cast("array<string>"), "doi": F.lit("")}
    return df.select(F.lit(source).alias("source"), *[c.alias(k) for k, c in (({"source_id": F.col("id"), "title": F.col("title")} | none) | columns).items()])


def _named(list_: Column) -> Column:
    return F.filter(F.transform(list_, lambda x: F.trim(x)), lambda x: x != "")


def nber(df: DataFrame, column: str = "feed") -> DataFrame:
    """Working papers: the number in the link; a summary "by A, B - day - text" gives authors and abstract."""
    parts = F.split("summary", " - ", 3)
    number = F.lower(F.regexp_extract("link", r"(?i)/papers/(w\d+)", 1))
    sid = F.when(number != "", number).when(F.col("id") != "", F.col("id")).otherwise(F.col("link"))
    by = (F.size(parts) > 1) & F.lower(parts[0]).startswith("by ")
    authors = F.when(by, _named(F.split(F.substr(parts[0], F.lit(4)), ","))).otherwise(F.array().cast("array<string>"))
    pdf = F.when(sid.startswith("w"), F.concat(F.lit("https://www.nber.org/papers/"), sid, F.lit(".pdf"))).otherwise("")
    return _paper(entries(df, column), "nber", source_id=sid, authors=authors, abstract=F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).otherwise(F.col("summary")), pdf_url=pdf)


def fed(df: DataFrame, column: str = "feed") -> DataFrame:
    """Discussion papers: the series' number in the summary or else in the entry's id."""
    number = lambda c: F.regexp_extract(c, r"(?i)\bFEDS\s*(?:Paper\s*)?(?:No\.?\s*)?(\d{4}-\d{2,4})", 1)
    sid = F.coalesce(F.nullif(number("summary"), F.lit("")), F.nullif(number("id"), F.lit("")), F.nullif("id", F.lit("")), F.col("link"))
    return _paper(entries(df, column), "fed_feds", source_id=sid, categories=F.array(F.lit("fed:FEDS")))


def wiley(df: DataFrame, column: str = "feed", journal: str | None = None) -> DataFrame:
    """Journals: the id is the DOI, else the link, else the head of the title; one creator may hold several names."""
    of = lambda c: F.when(F.lower(c).startswith("doi:"), F.substr(F.col(c), F.lit(5))).when(F.col(c).startswith("10."), F.col(c))
    doi = F.coalesce(of("prism_doi"), of("id"), F.lit(""))
    sid = F.coalesce(F.nullif(doi, F.lit("")), F.nullif("link", F.lit("")), F.substring("title", 1, 80))
    authors = F.when(F.size("creators") == 1, _named(F.split(F.get("creators", F.lit(0)), ","))).otherwise(F.col("creators"))
    df = entries(df, column, [journal] if journal else [])
    tags = F.array(F.concat(F.lit("wiley:"), F.col(journal))) if journal else F.array().cast("array<string>")
    return _paper(df, "wiley", source_id=sid, authors=authors, doi=doi, categories=tags, published=F.coalesce("published", F.nullif("cover_date", F.lit(""))))


ABSTRACT_ID = r"abstract_id=(\d+)"


def ssrn(feeds: DataFrame, pages: DataFrame, key: str = "journal", feed: str = "feed", html: str = "html") -> DataFrame:
    """Journals with a feed, and for those whose feed gives nothing the anchors of their page. Without a number or a title
    an entry is dropped."""
    number = F.regexp_extract("link", ABSTRACT_ID, 1)
    a = entries(feeds, feed, [key]).withColumn("_id", number).where("_id <> ''")
    b = anchors(pages, html, [key]).withColumn("_id", F.regexp_extract("href", ABSTRACT_ID, 1)).where("_id <> '' and title <> ''")
    b = b.join(a.select(key).distinct(), key, "left_anti").select(key, "_id", "title", F.lit("").alias("summary"), F.lit(None).cast("string").alias("published"))
    both = a.select(key, "_id", "title", "summary", "published").unionByName(b).withColumns({"id": F.col("_id"), "link": F.concat(F.lit("https://papers.ssrn.com/sol3/papers.cfm?abstract_id="), F.col("_id"))})
    return _paper(both, "ssrn", categories=F.array(F.concat(F.lit("ssrn_journal:"), F.col(key))))


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out: list[tuple[str, str]] = []
        self.href: str | None = None
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self._close()
            self.href = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag == "a":
            self._close()

    def handle_data(self, data):
        if self.href is not None:
            self.parts.append(data)

    def _close(self):
        if self.href is not None:
            self.out.append((self.href, _text(" ".join(self.parts))))
        self.href, self.parts = None, []


def read_anchors(page: str | None) -> list[tuple[str, str]]:
    p = _Anchors()
    p.feed(page or "")
    p.close()
    p._close()
    return p.out


def anchors(df: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """href and title (its text) of all links of a page, in their order."""
    return _each(df, column, lambda page: [(h, t, i) for i, (h, t) in enumerate(read_anchors(page))], "href string, title string, place int", keep or [])


def aqr(df: DataFrame, column: str = "html", root: str = "/Insights/Research/", site: str = "https://www.aqr.com") -> DataFrame:
    """Articles under the research folder: links four levels deep with a title of six letters; the first of each stays."""
    deep = F.length(F.regexp_replace(F.regexp_replace("href", "/+$", ""), "[^/]", "")) >= 4
    a = anchors(df, column).where(F.col("href").startswith(root) & deep & (F.length("title") >= 6))
    a = a.groupBy("href").agg(F.min_by("title", "place").alias("title"))
    kind = F.regexp_replace(F.regexp_extract("href", f"^{root}([^/]+)/", 1), "-", " ")
    a = a.withColumns({"id": F.regexp_replace("href", "/+$", ""), "link": F.concat(F.lit(site), F.col("href")), "summary": F.lit(""), "published": F.lit(None).cast("string")})
    return _paper(a, "aqr", categories=F.array(F.when(kind != "", F.concat(F.lit("aqr:"), kind)).otherwise("aqr")))


class _Report(HTMLParser):
    """Divisions p1, p2, ... with a titled link, each followed by a table of two-celled rows."""

    def __init__(self):
        super().__init__()
        self.papers: list[dict] = []
        self.cell: list[str] | None = None
        self.row: list[tuple[str, str]] = []
        self.title: list[str] | None = None
        self.table = False
        self.link = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "div" and (a.get("id") or "")[:1] == "p" and a["id"][1:].isdigit():
            self.papers.append({"href": "", "title": "", "meta": {}})
        elif tag == "a" and self.cell is None and self.papers and not self.papers[-1]["title"]:
            self.papers[-1]["href"], self.title = a.get("href") or "", []
        elif tag == "table":
            self.table = "basit" in (a.get("class") or "").split() and bool(self.papers) and not self.papers[-1]["meta"]
        elif self.table and tag == "tr":
            self.row = []
        elif self.table and tag == "td":
            self.cell, self.link = [], ""
        elif tag == "a" and self.cell is not None:
            self.link = self.link or a.get("href") or ""

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        elif self.title is not None:
            self.title.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.title is not None:
            self.papers[-1]["title"], self.title = _text(" ".join(self.title)), None
        elif tag == "td" and self.cell is not None:
            self.row.append((_text(" ".join(self.cell)), self.link))
            self.cell = None
        elif tag == "tr" and self.table and len(self.row) == 2:
            (label, _), (value, link) = self.row
            self.papers[-1]["meta"][label.rstrip(":").lower()] = value
            if link:
                self.papers[-1]["meta"]["href"] = link
        elif tag == "table":
            self.table = False


def read_report(page: str | None) -> list[tuple]:
    p = _Report()
    p.feed(page or "")
    p.close()
    m = lambda x, k: x["meta"].get(k, "")
    return [(x["href"], x["title"], m(x, "by"), m(x, "abstract"), m(x, "jel"), m(x, "date"), m(x, "href"), m(x, "url")) for x in p.papers if x["title"]]


def normal_date(text: Column) -> Column:
    """The first day that a text names: a whole one, else a month's or a year's first."""
    s = F.translate(text, "–—", "--")
    found = lambda p, tail: F.when(F.regexp_extract(s, p, 0) != "", F.concat(F.regexp_extract(s, p, 0), F.lit(tail)))
    return F.coalesce(found(r"\d{4}-\d{2}-\d{2}", ""), found(r"\d{4}-\d{2}", "-01"), found(r"\d{4}", "-01-01"))


def repec(df: DataFrame, column: str = "html", topic: str = "topic") -> DataFrame:
    """Reports of new papers: ids in the links, authors between semicolons, JEL codes as categories; no id, no paper."""
    from . import split_authors

    rows = _each(df, column, read_report, "href string, title string, by string, summary string, jel string, date string, url_href string, url string", [topic])
    number = lambda c: F.nullif(F.regexp_extract(c, r"(?i)RePEc:[a-z0-9]{3}:[a-z0-9]{6}:[^\s&\"'<>#?]+", 0), F.lit(""))
    rows = rows.withColumn("id", F.coalesce(number("href"), number("url_href"), number("url"))).where("id is not null")
    codes = F.filter(F.split("jel", r"\s+"), lambda x: (x != "") & (F.length(x) <= 5))
    tags = F.concat(F.array(F.concat(F.lit("nep:"), F.col(topic))), F.transform(codes, lambda x: F.concat(F.lit("jel:"), x)))
    rows = rows.withColumns({"link": F.coalesce(F.nullif("href", F.lit("")), F.nullif("url_href", F.lit("")), F.concat(F.lit("https://econpapers.repec.org/"), F.col("id"))), "published": normal_date(F.col("date"))})
    return _paper(rows, "repec", authors=split_authors(F.col("by")), categories=tags)
