"""Stand-in views over the driver's tables, as SQL text that Spark and DuckDB both take, and the runner for it.

bars: monthly OHLCV of a market segment; rets: with simple and log returns; equity: growth of one unit; hourly: event
bars; papers: documents as a corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CTES = {
    "bars": "SELECT c_mktsegment AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS volume, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "rets": "SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lret, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars",
    "small": "SELECT symbol, ts, k, volume, ret, 0.02 * ret / (1 + abs(ret)) AS r FROM rets WHERE ret IS NOT NULL",
    "equity": "SELECT symbol, ts, k, r, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY ts)) AS w FROM small",
    "dd": "SELECT symbol, ts, k, r, w, 1 - w / max(w) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM equity",
    "hourly": "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, max_by(value, event_id) AS close, min(value) AS low, max(value) AS high, sum(value) AS volume, count(*) AS n FROM events GROUP BY 1, 2",
    "papers": "SELECT source, CAST(doc_id AS STRING) AS source_id, doc_id, substring(text, 1, 80) AS title, text AS abstract, lang, n_chars, 1990 + doc_id % 30 AS year FROM documents",
    "flags": "SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS d FROM events",
    "daily": "SELECT event_type AS symbol, CAST(ts AS DATE) AS d, avg(value) AS v, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
}


def expand(body: str) -> str:
    """The body with the views it names, and those that they name, before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) and name not in need:
                visit(CTES[name])
                need.append(name)

    visit(body)
    own = body.strip()
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in need)
    if not head:
        return own
    return f"WITH {head}, {own[5:]}" if own.upper().startswith("WITH ") else f"WITH {head} {own}"


#: What the two engines spell differently: marker -> (Spark, DuckDB).
SPELLING = {
    "$rlike": ("regexp_like", "regexp_matches"),
    "$half_even(": ("bround(", "round_even("),
    "$pct(": ("percentile(", "quantile_cont("),
    "$days(": ("datediff(", "date_diff('day', "),
    "$kurt": ("kurtosis", "kurtosis_pop"),
    "$extract_all(": ("regexp_extract_all(", "regexp_extract_all("),
    "$split(": ("split(", "string_split_regex("),
    "$size(": ("size(", "len("),
    "$explode(": ("explode(", "unnest("),
    "$sorted(": ("array_sort(", "list_sort("),
    "$uniq(": ("array_distinct(", "list_distinct("),
    "$str": ("STRING", "VARCHAR"),
    "$list(": ("collect_list(", "list("),
    "$zero": ("decode(unhex('00'), 'UTF-8')", "chr(0)"),
}


#: Functions of a list and a value: name -> (Spark, DuckDB).
LISTS = {
    "below": (r"size(filter(\1, v -> v < \2))", r"len(list_filter(\1, lambda v: v < \2))"),
    "equal": (r"size(filter(\1, v -> v = \2))", r"len(list_filter(\1, lambda v: v = \2))"),
    # of an even number of values
    "median_dev": (
        r"(element_at(array_sort(transform(\1, v -> abs(v - \2))), CAST(size(\1) / 2 AS INT)) + element_at(array_sort(transform(\1, v -> abs(v - \2))), CAST(size(\1) / 2 AS INT) + 1)) / 2",
        r"list_median(list_transform(\1, lambda v: abs(v - \2)))",
    ),
}


def spell(text: str, duck: bool) -> str:
    """The text in one engine's spelling. Literals with a point are doubles, not decimals, in both."""
    text = re.sub(r"(?<![\w.'-])(-?\d+\.\d+)(?![\w.'])", r"\1e0", text)
    if not duck:
        text = re.sub(r"last_value\(((?:[^()]|\([^()]*\))+) IGNORE NULLS\)", r"last_value(\1) IGNORE NULLS", text)
    # how often a word is in a list of words
    tally = r"len(list_filter(\1, lambda w: w = \2))" if duck else r"size(filter(\1, w -> w = \2))"
    text = re.sub(r"\$tally\((\w+), ('[^']*')\)", tally, text)
    for name, (spark, own) in LISTS.items():
        text = re.sub(rf"\${name}\((\w+), (\w+)\)", own if duck else spark, text)
    for k, v in SPELLING.items():
        text = text.replace(k, v[duck])
    return text.replace(" AS STRING)", " AS VARCHAR)") if duck else text


def query(body: str):
    """A callable (spark, sf_dir) for SQL text over the tables and views."""
    text = spell(expand(body), False)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return run


def oracle(body: str) -> str:
    return spell(expand(body), True)
