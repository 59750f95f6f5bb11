"""Readers and writers of the corpus and of market panels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, day: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Columns of a parquet table between two days; both reach the scan."""
    df = spark.read.parquet(path)
    if first:
        df = df.where(F.col(day) >= F.lit(first))
    if last:
        df = df.where(F.col(day) <= F.lit(last))
    return df.select(*columns) if columns else df


def ledger(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones are an error (strict) or dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def events_csv(spark: SparkSession, path: str, schema: str, future: tuple[str, ...] = ()) -> DataFrame:
    """A calendar of events without the columns that only the future knows."""
    return spark.read.schema(schema).option("header", True).csv(path).drop(*future)


def atom(df: DataFrame, column: str) -> DataFrame:
    """Entries of Atom feeds (one feed a row): id without its version, title and summary on one line, authors, pdf link."""

    def parse(batches):
        import xml.etree.ElementTree as ET

        ns = "{http://www.w3.org/2005/Atom}"
        line = lambda s: " ".join((s or "").split())
        for pdf in batches:
            rows = []
            for text in pdf[column]:
                try:
                    feed = ET.fromstring(text)
                except (ET.ParseError, TypeError):
                    continue
                for e in feed.iter(f"{ns}entry"):
                    sid = (e.findtext(f"{ns}id") or "").rsplit("/", 1)[-1]
                    head, _, version = sid.rpartition("v")
                    pdf_url = next((x.get("href") for x in e.iter(f"{ns}link") if x.get("type") == "application/pdf"), None)
                    rows.append((head if head and version.isdigit() else sid, line(e.findtext(f"{ns}title")), line(e.findtext(f"{ns}summary")), e.findtext(f"{ns}published"), [a.findtext(f"{ns}name") or "" for a in e.iter(f"{ns}author")], [c.get("term") for c in e.iter(f"{ns}category")], pdf_url))
            yield pd.DataFrame(rows, columns=["source_id", "title", "abstract", "published", "authors", "categories", "pdf_url"])

    return df.select(column).mapInPandas(parse, "source_id string, title string, abstract string, published string, authors array<string>, categories array<string>, pdf_url string")


def split_authors(c):
    """Names between semicolons or the word `and`."""
    return F.filter(F.transform(F.split(c, r";|\sand\s"), lambda x: F.trim(x)), lambda x: x != "")
