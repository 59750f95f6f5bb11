"""The document corpus: filters, classification, retrieval, labels and listings."""

from __future__ import annotations

# Patterns of relevance and of the two kinds, in the invented vocabulary of the test corpus.
RELEVANT = "tion|ment|keit|idad"
STRATEGY = ("the ", "with ", "this ", " und ", " que ")
FACTOR = ("of ", "and ", "that ", " der ", " le ")
HITS = lambda ps: " + ".join(f"CASE WHEN $rlike(lower(abstract), '{p}') THEN 1 ELSE 0 END" for p in ps)
KIND = f"kd AS (SELECT *, CASE WHEN ({HITS(FACTOR)}) > ({HITS(STRATEGY)}) THEN 'factor' ELSE 'strategy' END AS auto_kind FROM papers), ek AS (SELECT kd.*, coalesce(CASE l.toxic WHEN 1 THEN 'factor' END, auto_kind) AS kind FROM kd LEFT JOIN labels l ON kd.doc_id = l.doc_id)"
QUERY = ("retion", "thein", "anre", "ening")
#: One list of words a document; its length and the query's terms are counted in the row, so that nothing is shuffled
#: but the counts of documents.
TERMS = f"tw AS (SELECT doc_id, $extract_all(lower(text), '[a-z]+', 0) AS words FROM documents), tf AS (SELECT doc_id, $size(words) AS len{''.join(f', $tally(words, {chr(39)}{t}{chr(39)}) AS f{k}' for k, t in enumerate(QUERY))} FROM tw), st AS (SELECT count(CASE WHEN len > 0 THEN 1 END) AS n, avg(CASE WHEN len > 0 THEN len END) AS avgdl{''.join(f', count_if(f{k} > 0) AS d{k}' for k in range(len(QUERY)))} FROM tf)"
BM25 = f"{TERMS}, sc AS (SELECT doc_id, {' + '.join(f'ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5)) * f{k} * 2.5 / (f{k} + 1.5 * (0.25 + 0.75 * len / avgdl))' for k in range(len(QUERY)))} AS score FROM tf CROSS JOIN st WHERE {' + '.join(f'f{k}' for k in range(len(QUERY)))} > 0)"
LEN = 1000
STEP = 850
CHUNKS = f"ch AS (SELECT doc_id, source, i, substring(text, i * {STEP} + 1, {LEN}) AS chunk FROM (SELECT doc_id, source, text, $explode($RANGE) AS i FROM documents WHERE length(text) > 0))"

SQL = {
    "relevance_filter": f"SELECT doc_id FROM documents WHERE $rlike(lower(text), '{RELEVANT}')",
    "relevance_hits": f"SELECT doc_id, array_to_me AS hits FROM (SELECT doc_id, $JOIN($sorted($uniq($extract_all(lower(text), '(tion|ment|keit|idad)', 0)))) AS array_to_me FROM documents) WHERE array_to_me <> ''",
    "like_search": "SELECT doc_id FROM papers WHERE lower(title) LIKE '%the%' OR lower(abstract) LIKE '%retion%'",
    "date_prefix": "SELECT event_id FROM events WHERE substring(CAST(ts AS STRING), 1, 10) = '2024-01-05'",
    "between_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-03-31 00:00:00'",
    "in_list": "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'it''s', 'fr')",
    "digit_codes": "SELECT DISTINCT source_id FROM papers WHERE $rlike(source_id, '^[0-9]+$')",
    "latest": "SELECT source, source_id, year FROM papers ORDER BY year DESC NULLS LAST, doc_id DESC LIMIT 20",
    "recent_since": "SELECT source_id, year FROM papers WHERE year >= 2015 ORDER BY year DESC, doc_id",
    "classify_kind": f"WITH {KIND} SELECT doc_id, auto_kind, kind FROM ek",
    "kind_counts": f"WITH {KIND} SELECT k.kind, count(ek.doc_id) AS n FROM (SELECT 'factor' AS kind UNION ALL SELECT 'strategy' UNION ALL SELECT 'other') k LEFT JOIN ek ON ek.kind = k.kind GROUP BY k.kind",
    "template_bucket": "SELECT doc_id, CASE WHEN $rlike(lower(abstract), 'trend|ation') THEN 'momentum' WHEN $rlike(lower(abstract), 'revert|rehe') THEN 'mean_reversion' ELSE 'buy_and_hold' END AS template FROM papers",
    "upsert_last_wins": "SELECT doc_id, batch, quality FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC) AS i FROM (SELECT doc_id, 1 AS batch, -1 AS quality FROM documents UNION ALL SELECT doc_id, 2 AS batch, quality FROM labels)) WHERE i = 1",
    "crawl_dates": "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events ORDER BY day DESC LIMIT 10",
    "runs_on_day": "SELECT event_id, event_type, value > 20 AS ok FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-07'",
    "normalize_whitespace": r"SELECT doc_id, length(trim($WS)) AS n FROM documents",
    "stable_hash": "SELECT doc_id, substring(sha1($HASHED), 1, 16) AS key FROM documents",
    "paper_slug": "SELECT doc_id, substring($SLUG, 1, 64) AS slug FROM papers",
    "bm25_topk": f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, doc_id LIMIT 50",
    "bm25_by_kind": f"WITH {BM25} SELECT sc.doc_id, round(score, 6) AS score FROM sc JOIN labels l ON sc.doc_id = l.doc_id AND l.quality = 1 ORDER BY round(score, 6) DESC, sc.doc_id LIMIT 25",
    "chunks": f"WITH {CHUNKS} SELECT doc_id, i, length(chunk) AS n FROM ch",
    "chunks_per_paper": f"WITH {CHUNKS} SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS papers FROM ch GROUP BY source",
    "summary_card": "SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM labels) AS labelled, (SELECT count(*) FROM labels WHERE quality = 1) AS good, (SELECT count(DISTINCT source) FROM documents) AS sources",
    "catalog_coverage": "SELECT CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, count(*) AS n FROM orders",
    "json_extract": "SELECT event_id, CAST($JSON AS BIGINT) AS k FROM events",
    "business_days": "SELECT d, $DOW AS dow, d + CASE WHEN $DOW = 5 THEN 3 WHEN $DOW = 6 THEN 2 ELSE 1 END AS next_business_day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)",
    "periods_per_year": "SELECT symbol, $pct(gap, 0.5) AS median_gap FROM (SELECT symbol, $days(GAP) AS gap FROM bars) WHERE gap IS NOT NULL GROUP BY symbol",
    "links_in_pages": "SELECT page_id, $size($extract_all(html, 'href=\"([^\"]+)\"', 1)) AS links, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages",
    "dialogue_turns": "SELECT conv_id, count(*) AS turns, count_if(role = 'user') AS user_turns, sum(length(text)) AS n_chars FROM conversations GROUP BY conv_id",
}

_WORDS = {
    "$RANGE": (f"sequence(0, greatest(0, CAST(ceil((length(text) - {LEN}) / CAST({STEP} AS DOUBLE)) AS INT)))", f"range(0, greatest(0, CAST(ceil((length(text) - {LEN}) / CAST({STEP} AS DOUBLE)) AS INT)) + 1)"),
    "$JOIN(": ("concat_ws(',', ", "concat_ws_list("),
    "$WS": (r"regexp_replace(text, '\\s+', ' ')", r"regexp_replace(text, '\s+', ' ', 'g')"),
    "$SLUG": ("regexp_replace(lower(concat(source, '-', source_id)), '[^a-z0-9]+', '-')", "regexp_replace(lower(concat(source, '-', source_id)), '[^a-z0-9]+', '-', 'g')"),
    "$HASHED": ("concat(encode(source, 'UTF-8'), unhex('00'), encode(CAST(doc_id AS STRING), 'UTF-8'), unhex('00'))", "CAST(encode(source) || '\\x00'::BLOB || encode(CAST(doc_id AS STRING)) || '\\x00'::BLOB AS BLOB)"),
    "$JSON": ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
    "$DOW": ("(weekday(d) + 1)", "isodow(d)"),
    "GAP": ("ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts)", "lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts"),
}


def sql(name: str, duck: bool) -> str:
    text = SQL[name]
    for k, v in _WORDS.items():
        text = text.replace(k, v[duck])
    return text.replace("concat_ws_list($sorted(", "array_to_string(list_sort(").replace(") AS array_to_me", ", ',') AS array_to_me" if duck else ") AS array_to_me") if name == "relevance_hits" and duck else text
