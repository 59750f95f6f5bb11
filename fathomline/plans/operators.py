"""Queries that apply the operators' functions to the tables, and SQL of their own for the same results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import ship
from ..functions import vocabulary as V
from ..operators import causal, classify, library, multiscale, portfolio, risk, validation, volume
from . import series
from .views import expand, query, spell

W = series.W


def on(body: str, then):
    """A query that applies `then` to the rows of SQL text over the views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return then(query(body)(spark, sf_dir))

    return run


def _col(df: DataFrame, name: str, digits: int | None = None, *keys: str) -> DataFrame:
    return df.select(*(keys or ("symbol", "ts")), F.round(name, digits).alias(name) if digits is not None else F.col(name))


RETS, BARS, DD, EQUITY, SMALL = (f"SELECT * FROM {t}" for t in ("rets", "bars", "dd", "equity", "small"))

#: Functions in place of the SQL text of the same names, which stays as their oracle.
FACTORS = {
    "excess_volume": on(RETS, lambda d: _col(volume.excess_volume(d, W), "z", 8)),
    "volume_breakout": on(RETS, lambda d: _col(volume.volume_breakout(d, W, 1.0), "breakout")),
    "obv": on(RETS, lambda d: _col(volume.obv(d), "obv", 4)),
    "obv_slope": on(RETS, lambda d: _col(volume.obv_slope(d, W), "obv_slope", 8)),
    "price_volume_divergence": on(RETS, lambda d: _col(volume.price_volume_divergence(d, W), "corr", 8)),
    "divergence_flag": on(RETS, lambda d: _col(volume.divergence_flag(d, W), "flag")),
    "typical_price": on(BARS, lambda d: _col(volume.typical_price(d), "typical_price", 6)),
    "rolling_vwap": on(RETS, lambda d: _col(volume.rolling_vwap(d, W), "vwap", 6)),
    "vwap_deviation": on(RETS, lambda d: _col(volume.vwap_deviation(d, W), "deviation", 8)),
    "twap": on(BARS, lambda d: _col(volume.twap(d), "twap", 6)),
    "amihud_illiquidity": on(RETS, lambda d: _col(volume.amihud_illiquidity(d, W), "illiquidity", 8)),
    "standardize_zscore": on(RETS, lambda d: _col(volume.standardize(d, "ret", W), "z", 8)),
    "detrend_ols": on(RETS, lambda d: _col(volume.detrend(d, "close", "ols", window=W, out="residual"), "residual", 4)),
    "rolling_ols_slope": on(RETS, lambda d: _col(volume.rolling_ols_slope(d, "close", W), "slope", 6)),
    "drawdown_series": on(EQUITY, lambda d: _col(risk.drawdown_series(d), "drawdown", 10)),
    "max_drawdown": on(EQUITY, lambda d: _col(risk.max_drawdown(d), "max_drawdown", 10, "symbol")),
    "drawdown_table": on(EQUITY, lambda d: risk.drawdown_table(d).withColumn("depth", F.round("depth", 10))),
    "ulcer_index": on(EQUITY, lambda d: _col(risk.ulcer_index(d), "ulcer", 10, "symbol")),
    "time_under_water": on(EQUITY, risk.time_under_water),
    "equity_from_returns": on(SMALL, lambda d: _col(risk.equity(d, out="equity"), "equity", 10)),
    "cagr": on(SMALL, lambda d: _col(risk.cagr(d, periods=12), "cagr", 10, "symbol")),
    "calmar_ratio": on(SMALL, lambda d: _col(risk.calmar_ratio(d), "calmar", 8, "symbol")),
    "ratio_report": on(SMALL, lambda d: risk.ratio_report(d, periods=12).select("symbol", "n", *[F.round(c, 8).alias(c) for c in ("cagr", "sharpe", "sortino", "sortino_downside", "max_drawdown", "ulcer", "martin", "sterling")])),
    "grossman_zhou_leverage": on(DD, lambda d: d.where("d < 1").select("symbol", "ts", F.round(risk.grossman_zhou_leverage(F.col("d"), 0.8, 2.0), 8).alias("leverage"))),
}

TEXT = "coalesce(text, '')"
#: A text about the subjects of the vocabulary for each document, so that the patterns meet something: phrases by the id.
PHRASES = ("momentum and trend-following futures", "the value factor and book-to-market", "a trading strategy with a backtest", "mean reversion, RSI and an oscillator", "cross-sectional anomalies in expected returns", "pairs trading by cointegration", "machine learning on order flow", "carry and roll yield in commodity markets", "Taiwan index futures, long-short", "bonds and the yield curve")
PAPERS = "SELECT doc_id, source, concat(CASE " + " ".join(f"WHEN doc_id % 10 = {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END, ' ', CASE " + " ".join(f"WHEN n_chars % 10 = {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + f" END, ' ', {TEXT}) AS body FROM documents"


def _hit(p: str) -> str:
    return f"regexp_matches(body, '(?i){p}')"


def _any(patterns) -> str:
    return _hit("|".join(f"(?:{p})" for p in patterns))


def _tags(table: dict) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(p)} THEN '{n}' END" for n, p in table.items()) + "], lambda x: x IS NOT NULL)"


def _score(patterns) -> str:
    return " + ".join(f"CAST({_hit(p)} AS INT)" for p in patterns)


def _matched(patterns) -> str:
    whole = " || ".join(f"list_transform(regexp_extract_all(body, '(?i){p}', 0), lambda x: lower(x))" for p in patterns)
    return f"list_transform(list_sort(list_transform(list_distinct({whole}), lambda x: {{'i': list_position({whole}, x), 'x': x}})), lambda s: s.x)"


_text = lambda: F.col("body")
_joined = lambda c: F.array_join(c, ",")
_FLAT = f"list_concat({_tags(V.FAMILY)}, {_tags(V.SIGNAL)}, {_tags(V.DIRECTION)})"


def _once(lists: str) -> str:
    return f"list_transform(list_sort(list_transform(list_distinct({lists}), lambda x: {{'i': list_position({lists}, x), 'x': x}})), lambda s: s.x)"


def _chunks(d: DataFrame) -> DataFrame:
    return library.chunks(d, ["doc_id", "source"])


DOCS = "SELECT doc_id, source, text FROM documents"
#: The windows of a text as recursive SQL: each start follows from the end before.
CHUNK_SQL = r"""RECURSIVE n AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, source, t, 0 AS idx, 0 AS s, CASE WHEN length(t) <= 1000 THEN length(t) WHEN strpos(reverse(substring(t, 851, 150)), ' ') > 0 THEN 1000 - strpos(reverse(substring(t, 851, 150)), ' ') ELSE 1000 END AS e FROM n WHERE t <> ''
UNION ALL SELECT doc_id, source, t, idx + 1, b, CASE WHEN b + 1000 >= length(t) THEN length(t) WHEN strpos(reverse(substring(t, b + 851, 150)), ' ') > 0 THEN b + 1000 - strpos(reverse(substring(t, b + 851, 150)), ' ') ELSE b + 1000 END FROM (SELECT *, greatest(e - 150, s + 1) AS b FROM w WHERE e < length(t))),
c AS (SELECT doc_id, source, idx, trim(substring(t, s + 1, e - s)) AS chunk FROM w)"""
QUERY = "retion thein, ening!"
_TERMS = library.query_terms(QUERY)
_BM = ", ".join(f"len(list_filter(ws, lambda x: x = '{t}')) AS f{k}" for k, t in enumerate(_TERMS))
_ST = ", ".join(f"count_if(f{k} > 0) AS d{k}" for k in range(len(_TERMS)))
_SC = " + ".join(f"ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5)) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / avgl))" for k in range(len(_TERMS)))
BM_SQL = rf"f AS (SELECT c.*, len(regexp_extract_all(lower(chunk), '[\p{{L}}\p{{N}}\p{{Mn}}\p{{Mc}}_]+', 0)) AS len, {_BM} FROM (SELECT *, regexp_extract_all(lower(chunk), '[\p{{L}}\p{{N}}\p{{Mn}}\p{{Mc}}_]+', 0) AS ws FROM c) c), st AS (SELECT count(*) AS n, avg(len) AS avgl, {_ST} FROM f), sc AS (SELECT doc_id, source, idx, {_SC} AS score FROM f, st WHERE {' + '.join(f'f{k}' for k in range(len(_TERMS)))} > 0)"
_words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Mn}\p{Mc}_]+"), F.lit(0))


def _search(d: DataFrame) -> DataFrame:
    scored = library.bm25(_chunks(d), "chunk", _TERMS, k1=1.2, words=_words)
    return scored.select("doc_id", "idx", F.round("score", 3).alias("score")).orderBy(F.desc("score"), "doc_id", "idx").limit(30)


LABELS = "SELECT l.doc_id, CASE WHEN quality = 1 THEN 'factor' WHEN toxic = 1 THEN 'strategy' END AS kind, CASE WHEN toxic = 1 THEN 'flagged,momentum' ELSE 'checked' END AS more FROM labels l"


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, labels = query(PAPERS)(spark, sf_dir), query(LABELS)(spark, sf_dir)
    labels = labels.withColumn("subcats", F.split("more", ","))
    got = library.effective(papers, labels, ["doc_id"], _text())
    return got.select("doc_id", "auto_kind", "kind", _joined("subcats").alias("subcats"))


PLR = "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS cluster, l_extendedprice / l_quantity AS y, l_discount AS d, l_tax AS x1, l_quantity AS x2 FROM lineitem"


def _cross_fit(d: DataFrame) -> DataFrame:
    d = d.withColumn("fold", F.month("cluster") % 4)
    got = causal.cross_fit_residuals(d, ["y", "d"], ["x1"])
    a, b = F.col("res_d"), F.col("res_y")
    return got.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.sum(a * b) / F.sum(a * a), 5).alias("theta"))


def _effect(d: DataFrame) -> DataFrame:
    e = causal.plr_effect(d, "d", "y", ["x1", "x2"], "cluster")
    return d.sparkSession.createDataFrame([(e.n, e.clusters, e.theta, e.se, e.p, e.low, e.high, e.se_iid)], "n long, clusters long, theta double, se double, p double, low double, high double, se_iid double")


def _verdict(d: DataFrame) -> DataFrame:
    v = causal.verdict(d, "d", "y", ["x1", "x2"], "cluster")
    return d.sparkSession.createDataFrame([(v["verdict"], v["by_period"]["periods"], v["by_period"]["t"], v["signs"]["share"])], "verdict string, periods long, t double, block_share double")


def _report(d: DataFrame) -> DataFrame:
    return validation.validation_report(d, trials=5).select("symbol", "n", "periods", *[F.round(c, 5).alias(c) for c in ("cagr", "sharpe", "max_drawdown", "psr")])


SIGNALS = "SELECT symbol, ts, k, close AS price, ret, sign(ret) AS direction, abs(ret) / (1 + abs(ret)) AS confidence FROM rets WHERE ret IS NOT NULL"

QUERIES = FACTORS | {
    "spearman_divergence": on(RETS, lambda d: _col(volume.price_volume_divergence(d, W, "spearman"), "corr", 6)),
    "standardize_expanding": on(RETS, lambda d: _col(volume.standardize(d, "ret", None), "z", 8)),
    "standardize_rank_expanding": on(RETS, lambda d: _col(volume.standardize(d, "ret", None, "rank", out="score"), "score", 8)),
    "mdd_scaling_check": on(SMALL, lambda d: risk.mdd_scaling_check(d).select("symbol", "horizon", "blocks", F.round("mean_mdd", 8).alias("mean_mdd"))),
    "annual_drawdowns": on(SMALL, lambda d: risk.annual_drawdowns(d).select("symbol", "year", "n", F.round("max_drawdown", 8).alias("max_drawdown"))),
    "classify_paper": on(PAPERS, lambda d: classify.kind(d, _text()).select("doc_id", "factor_score", "strategy_score", "kind", _joined("subcats").alias("subcats"))),
    "relevance_of_papers": on(PAPERS, lambda d: d.where(classify.relevant(_text())).select("doc_id", _joined(classify.relevance_hits(_text())).alias("hits"))),
    "template_of_papers": on(PAPERS, lambda d: classify.template(d, _text()).select("doc_id", "template", _joined("matched").alias("matched"))),
    "taxonomy_tags": on(PAPERS, lambda d: classify.taxonomy(d, _text()).select("doc_id", *[_joined(c).alias(c) for c in V.DIMENSIONS])),
    "flat_tags": on(PAPERS, lambda d: d.select("doc_id", _joined(classify.flat_tags(_text())).alias("tags"))),
    "assembled_tags": on(PAPERS, lambda d: classify.template(d, _text()).select("doc_id", _joined(classify.assembled_tags(_text(), F.col("template"), ("generated",), "index-future")).alias("tags"))),
    "enriched_papers": _enriched,
    "chunk_windows": on(DOCS, lambda d: _chunks(d).select("doc_id", "idx", F.length("chunk").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("digest"))),
    "search_chunks": on(DOCS, _search),
    "fulltext_of_chunks": on(DOCS, lambda d: library.get_chunks(_chunks(d), ["doc_id"]).select("doc_id", "n_chunks", F.length("fulltext").alias("n_chars"))),
    "list_indexed": on(DOCS, lambda d: library.list_indexed(_chunks(d), d.select("doc_id", "source"), ["doc_id", "source"])),
    "pdf_filenames": on("SELECT doc_id, source FROM documents", lambda d: d.select("doc_id", library.pdf_filename(F.col("source"), F.col("doc_id").cast("string")).alias("file"), library.paper_slug(F.col("source"), F.col("doc_id").cast("string")).alias("slug"))),
    "knowledge_time": on("SELECT event_id, CAST(ts AS STRING) AS a, CAST(ts + INTERVAL 3 DAY AS STRING) AS b FROM events", lambda d: d.select("event_id", F.to_date(library.knowledge_time(F.col("a"), F.col("b"))).alias("known"))),
    "contaminated_dates": on("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders", lambda d: d.select("d", library.contaminated(F.col("d"), "1996-06-14", 10).alias("contaminated"))),
    "first_json_object": on("SELECT conv_id, turn, concat('Sure: ```json ', '{\"k\": ', CAST(turn AS STRING), '}', '``` ', coalesce(role, '')) AS reply FROM conversations", lambda d: d.select("conv_id", "turn", library.first_json("reply").alias("object"))),
    "label_changes": on("SELECT doc_id, quality, toxic FROM labels", lambda d: _label_changes(d)),
    "run_accounts": on("SELECT user_id AS run_id, ts, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'finish' END AS event, CASE WHEN value > 90 THEN 'late' END AS error FROM events", lambda d: library.run_accounts(d).select("run_id", F.to_date("started").alias("started"), F.to_date("finished").alias("finished"), "ok")),
    "ledger_append": on("SELECT event_type AS k, event_id, value FROM events", lambda d: library.appended(d.where("false"), d, "k", "event_id")),
    "chi2_tails": on("SELECT o_orderkey AS id, o_totalprice / 20000 AS x, CAST(2 * (1 + o_orderkey % 6) AS INT) AS df FROM orders", lambda d: _tails(d)),
    "acf_ljung_box": on(SMALL, lambda d: validation.ljung_box(d, (4, 10), by="symbol").select("symbol", "lags", F.round("q", 6).alias("q"), F.round("p", 6).alias("p"))),
    "ljung_box_absolute": on(SMALL, lambda d: validation.ljung_box(d, (4, 10), absolute=True, by="symbol").select("symbol", "lags", F.round("q", 6).alias("q"), F.round("p", 6).alias("p"))),
    "t_test_with_p": on(SMALL, lambda d: validation.t_test(d).select("symbol", "n", F.round("t", 6).alias("t"), F.round("p", 8).alias("p"))),
    "probabilistic_sharpe": on(SMALL, lambda d: validation.deflated_sharpe(d, 20).select("symbol", "n", *[F.round(c, 6).alias(c) for c in ("sr", "psr", "benchmark", "dsr")])),
    "modwt_haar": on(SMALL, lambda d: multiscale.modwt(d, 3).select("symbol", "ts", *[F.round(c, 10).alias(c) for c in ("w1", "w2", "w3", "v3")])),
    "modwt_d4": on(SMALL, lambda d: multiscale.modwt(d, 2, "d4").select("symbol", "ts", *[F.round(c, 10).alias(c) for c in ("w1", "w2", "v2")])),
    "cross_scale_resonance": on(SMALL, lambda d: multiscale.resonance(d, 3).where("resonance is not null").select("symbol", "ts", F.round("resonance", 8).alias("resonance"))),
    "mra_parts": on(SMALL, lambda d: multiscale.mra(d, 3)),
    "lift_by_symbol": on("SELECT symbol, ret > 0 AS up, lead(ret) OVER (PARTITION BY symbol ORDER BY ts) > 0 AS next_up FROM rets WHERE ret IS NOT NULL", lambda d: multiscale.conditional_lift(d, F.col("up"), F.col("next_up"), ["symbol"]).select("symbol", "n", "n_cond", F.round("lift", 8).alias("lift"), F.round("z", 6).alias("z"))),
    "suitability": on(SMALL, lambda d: validation.suitability(d, qs=(2, 4, 8)).withColumn("score", F.round("score", 6))),
    "variance_ratio": on(SMALL, lambda d: validation.variance_ratio(d).select("symbol", F.col("q").cast("double").alias("q"), F.round("vr", 8).alias("vr"), *[F.round(c, 6).alias(c) for c in ("z", "p", "z_het", "p_het")])),
    "cpcv_splits": on("SELECT DISTINCT CAST(k - 1 AS BIGINT) AS k FROM rets", lambda d: validation.cpcv(d, 6, 2, 1).groupBy("split").agg(F.count_if(F.col("role") == "test").alias("test"), F.count_if(F.col("role") == "train").alias("train"), F.sum(F.when(F.col("role") == "test", F.col("k"))).alias("checksum"))),
    "pbo_by_sharpe": on(SMALL, lambda d: validation.pbo(d)),
    "validation_report": on(SMALL, _report),
    "derived_facts": on(SMALL, lambda d: validation.facts(d).select("symbol", "n", "n_eff", "lags", F.round("jb_p", 6).alias("jb_p"), F.round("lb_p", 6).alias("lb_p"))),
    "decision_rules": on(SMALL, lambda d: validation.resolved(validation.moments(d).select(F.col("symbol").alias("key"), F.lit("sr").alias("name"), F.col("sr").alias("value")), RULES).select("key", "slot", "verdict")),
    "triage_first_of_class": on("SELECT doc_id, source, lang FROM documents", lambda d: validation.first_of_class(d, ["source", "lang"], "doc_id").select("doc_id", "duplicate", "representative")),
    "bootstrap_sharpe": on(SMALL, lambda d: validation.bootstrap_sharpe(d, periods=12)),
    "sign_flip": on(SMALL, validation.sign_flip),
    "cross_fit_residuals": on(PLR, _cross_fit),
    "plr_cross_fit": on(PLR, _effect),
    "causal_verdict": on(PLR, _verdict),
    "panel_build": on(BARS, lambda d: portfolio.panel(d).select("symbol", "month", *[F.round(c, 8).alias(c) for c in ("mom", "rev", "fwd_ret", "vol", "other_mom")])),
    "sector_deciles": on("SELECT symbol, ts, ret, CASE WHEN symbol < 'G' THEN 'a' ELSE 'b' END AS sector FROM rets WHERE ret IS NOT NULL", lambda d: portfolio.sector_deciles(d, "ret", 0.3, sector="sector").select("symbol", "ts", "leg")),
    "basket_hedge": on("SELECT a.symbol, a.ts, a.ret, m.mkt, 0.5 AS weight FROM rets a JOIN (SELECT ts, avg(ret) AS mkt FROM rets GROUP BY ts) m ON a.ts = m.ts WHERE a.ret IS NOT NULL", lambda d: portfolio.basket_hedge(portfolio.betas(d, "ret", "mkt", 24)).select("ts", F.round("basket_beta", 8).alias("basket_beta"), F.round("hedge", 8).alias("hedge"))),
    "threshold_policy": on(SIGNALS, lambda d: d.select("symbol", "ts", portfolio.threshold_policy(F.col("direction"), F.col("confidence"), 0.3, 0.5).alias("weight"))),
    "simulate_contracts": on(SIGNALS, lambda d: _col(portfolio.simulate(d, "direction", "price", "ret", fee=10, slippage=1), "pnl", 8)),
    "nested_walk_forward": on(SIGNALS, lambda d: portfolio.nested_walk_forward(d, [0.1, 0.3, 0.5], 80, 24, 12, periods=12, whole=False).select("symbol", "fold", "chosen", *[F.round(c, 6).alias(c) for c in ("is_sharpe", "oos_sharpe")])),
    "timing_legs": on("SELECT symbol, ts, abs(ret) / (1 + abs(ret)) AS score FROM rets WHERE ret IS NOT NULL", portfolio.timing_legs),
    "tail_hedge": on(BARS, lambda d: portfolio.tail_hedge(d, lookback=6)),
    "event_hold_capacity": on("SELECT 'book' AS g, CAST(user_id AS STRING) AS symbol, CAST(ts AS DATE) AS d, value FROM events", lambda d: portfolio.event_hold(d.where("value > 60"), d, 3, 5)),
    "event_window_rows": on("SELECT symbol, ts, ret > 1 AS flag FROM rets", lambda d: portfolio.event_window(d, "flag", 1, 3).select("symbol", "ts", "inside")),
    "complexity_gap": on("SELECT 'all' AS g, symbol, ts, r FROM small", portfolio.complexity_gap),
    "memorization_probe": on("SELECT doc_id, n_chars * 1.0 AS actual, CASE WHEN doc_id % 3 > 0 THEN n_chars * (1 + (doc_id % 7) / 50.0) END AS guess, CAST(CASE WHEN doc_id % 2 = 0 THEN '2023-06-01' ELSE '2024-06-01' END AS DATE) AS day FROM documents", lambda d: portfolio.memorization(d).select("n_pre", "answered_pre", F.round("median_pre", 6).alias("median_pre"), "n_post", "answered_post", F.round("median_post", 6).alias("median_post"), "leak_suspected")),
    "trim_tail_zeros": on("SELECT symbol, ts, CASE WHEN k > 60 THEN 0.0 ELSE ret END AS r FROM rets", lambda d: portfolio.trim_tail_zeros(d).select("symbol", "ts")),
    "front_contract": on("SELECT event_type AS root, CAST(ts AS DATE) AS d, user_id AS expiry, sum(value) AS volume FROM events GROUP BY 1, 2, 3", lambda d: portfolio.front(d, ["root", "d"]).select("root", "d", "expiry")),
}

RULES = [{"slot": "skill", "name": "sr", "low": None, "high": 0.0, "verdict": "none"}, {"slot": "skill", "name": "sr", "low": 0.0, "high": 0.1, "verdict": "weak"}, {"slot": "skill", "name": "sr", "low": 0.1, "high": None, "verdict": "some"}]


def _label_changes(d: DataFrame) -> DataFrame:
    old = d.select("doc_id", F.lit(None).cast("string").alias("kind"), F.array(F.lit("old")).alias("subcats"))
    add = d.where("quality = 1").select("doc_id", F.lit(1).alias("seq"), F.lit("add").alias("action"), F.lit("  Value ").alias("value"))
    drop = d.where("toxic = 1").select("doc_id", F.lit(2).alias("seq"), F.lit("remove").alias("action"), F.lit("old").alias("value"))
    kind = d.select("doc_id", F.lit(3).alias("seq"), F.lit("kind").alias("action"), F.when(F.col("quality") == 1, "factor").alias("value"))
    return library.labelled(old, add.unionByName(drop).unionByName(kind), ["doc_id"]).select("doc_id", "kind", _joined("subcats").alias("subcats"))


def _tails(d: DataFrame) -> DataFrame:
    from ..functions import tails

    return d.select("id", F.round(tails.chi2_tail(F.col("x"), F.col("df")), 8).alias("p"))


_CHI = "exp(-x / 2) * (1" + "".join(f" + CASE WHEN df > {2 * i} THEN power(x / 2, {i}) / {math.factorial(i)}.0 ELSE 0 END" for i in range(1, 6)) + ")"
_RANK = "list_transform(L, lambda e: len(list_filter(L, lambda o: o < e)) + (len(list_filter(L, lambda o: o = e)) + 1) / 2.0)"

_G, _H = multiscale.filters("d4")
_P = "OVER (PARTITION BY symbol ORDER BY ts)"
_tap = lambda f, c, step: " + ".join(f"({a!r}) * lag({c}, {step * k}, 0.0) {_P}" for k, a in enumerate(map(float, f)))

RAW = {
    "modwt_d4": f"WITH a AS (SELECT symbol, ts, row_number() {_P} AS i, {_tap(_H, 'r', 1)} AS w1, {_tap(_G, 'r', 1)} AS v1 FROM small), b AS (SELECT symbol, ts, i, w1, {_tap(_H, 'v1', 2)} AS w2, {_tap(_G, 'v1', 2)} AS v2 FROM a) SELECT symbol, ts, CASE WHEN i >= 4 THEN round(w1, 10) END AS w1, CASE WHEN i >= 10 THEN round(w2, 10) END AS w2, CASE WHEN i >= 10 THEN round(v2, 10) END AS v2 FROM b",
    "lift_by_symbol": "WITH x AS (SELECT symbol, ret > 0 AS up, lead(ret) OVER (PARTITION BY symbol ORDER BY ts) > 0 AS y FROM rets WHERE ret IS NOT NULL), q AS (SELECT symbol, count(*) AS n, count_if(up) AS n_cond, count_if(y) AS k, count_if(up AND y) AS kc FROM x WHERE y IS NOT NULL GROUP BY symbol), s AS (SELECT *, 1.0 * k / n AS p0, 1.0 * kc / n_cond AS p1, 1.0 * (k + kc) / (n + n_cond) AS p FROM q) SELECT symbol, n, n_cond, round(p1 / p0, 8) AS lift, round((p1 - p0) / sqrt(p * (1 - p) * (1.0 / n + 1.0 / n_cond)), 6) AS z FROM s",
    "classify_paper": f"WITH p AS ({PAPERS}), s AS (SELECT *, {_score(V.FACTOR)} AS factor_score, {_score(V.STRATEGY)} AS strategy_score FROM p) SELECT doc_id, factor_score, strategy_score, CASE WHEN factor_score > strategy_score THEN 'factor' ELSE 'strategy' END AS kind, array_to_string(CASE WHEN factor_score > strategy_score THEN {_tags(V.FACTOR_SUBCATS)} ELSE {_tags(V.STRATEGY_SUBCATS)} END, ',') AS subcats FROM s",
    "relevance_of_papers": f"WITH p AS ({PAPERS}) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, '(?i){'|'.join(f'(?:{p})' for p in V.RELEVANCE)}', 0), lambda x: lower(x)))), ',') AS hits FROM p WHERE {_any(V.RELEVANCE)}",
    "template_of_papers": f"WITH p AS ({PAPERS}), m AS (SELECT doc_id, {_matched(V.TEMPLATES['momentum'])} AS a, {_matched(V.TEMPLATES['mean_reversion'])} AS b FROM p) SELECT doc_id, CASE WHEN len(a) > 0 THEN 'momentum' WHEN len(b) > 0 THEN 'mean_reversion' ELSE 'buy_and_hold' END AS template, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE b END, ',') AS matched FROM m",
    "taxonomy_tags": f"WITH p AS ({PAPERS}) SELECT doc_id, " + ", ".join(f"array_to_string({_tags(t)}, ',') AS {d}" for d, t in V.DIMENSIONS.items()) + " FROM p",
    "flat_tags": f"WITH p AS ({PAPERS}), l AS (SELECT doc_id, {_FLAT} AS l FROM p) SELECT doc_id, array_to_string({_once('l')}, ',') AS tags FROM l",
    "assembled_tags": f"WITH p AS ({PAPERS}), l AS (SELECT doc_id, list_concat(list_concat(['generated', 'index-future'], {_FLAT}), CASE WHEN {_any(V.TEMPLATES['momentum'])} THEN ['momentum'] WHEN {_any(V.TEMPLATES['mean_reversion'])} THEN ['mean-reversion', 'technical'] ELSE ['baseline', 'buy-and-hold'] END) AS l FROM p) SELECT doc_id, array_to_string({_once('l')}, ',') AS tags FROM l",
    "enriched_papers": f"WITH p AS ({PAPERS}), s AS (SELECT p.*, CASE WHEN {_score(V.FACTOR)} > {_score(V.STRATEGY)} THEN 'factor' ELSE 'strategy' END AS auto_kind FROM p), j AS (SELECT s.*, coalesce(l.kind, auto_kind) AS kind, coalesce(string_split(l.more, ','), []) AS more FROM s LEFT JOIN ({LABELS}) l ON s.doc_id = l.doc_id), t AS (SELECT *, CASE WHEN kind = 'factor' THEN {_tags(V.FACTOR_SUBCATS)} ELSE {_tags(V.STRATEGY_SUBCATS)} END AS own FROM j) SELECT doc_id, auto_kind, kind, array_to_string(list_concat(own, list_filter(more, lambda x: NOT list_contains(own, x))), ',') AS subcats FROM t",
    "chunk_windows": f"WITH {CHUNK_SQL} SELECT doc_id, idx, length(chunk) AS n, md5(chunk) AS digest FROM c",
    "search_chunks": f"WITH {CHUNK_SQL}, {BM_SQL} SELECT doc_id, idx, round(score, 3) AS score FROM sc ORDER BY round(score, 3) DESC, doc_id, idx LIMIT 30",
    "fulltext_of_chunks": f"WITH {CHUNK_SQL} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(chunk)) + 2 * (count(*) - 1) AS BIGINT) AS n_chars FROM c GROUP BY doc_id",
    "list_indexed": f"WITH {CHUNK_SQL} SELECT doc_id, source, count(*) AS n_chunks FROM c GROUP BY doc_id, source",
    "pdf_filenames": "SELECT doc_id, concat(substring(trim(regexp_replace(lower(concat(source, '_', CAST(doc_id AS VARCHAR))), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80), '.pdf') AS file, substring(trim(regexp_replace(lower(concat(source, '_', CAST(doc_id AS VARCHAR))), '[^a-z0-9]+', '_', 'g'), '_'), 1, 64) AS slug FROM documents",
    "knowledge_time": "SELECT event_id, CAST(ts + INTERVAL 3 DAY AS DATE) AS known FROM events",
    "contaminated_dates": "WITH RECURSIVE b AS (SELECT DATE '1996-06-14' AS d, 0 AS n UNION ALL SELECT d + 1, n + CASE WHEN isodow(d + 1) <= 5 THEN 1 ELSE 0 END FROM b WHERE n < 11), s AS (SELECT min(d) AS d FROM b WHERE n = 11) SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) < s.d AS contaminated FROM orders, s",
    "first_json_object": "SELECT conv_id, turn, concat('{\"k\": ', CAST(turn AS VARCHAR), '}') AS object FROM conversations",
    "label_changes": "SELECT doc_id, CASE WHEN quality = 1 THEN 'factor' END AS kind, array_to_string(list_concat(CASE WHEN toxic = 1 THEN [] ELSE ['old'] END, CASE WHEN quality = 1 THEN ['value'] ELSE [] END), ',') AS subcats FROM labels",
    "run_accounts": "SELECT user_id AS run_id, CAST(min(CASE WHEN event_id % 2 = 0 THEN ts END) AS DATE) AS started, CAST(max(CASE WHEN event_id % 2 = 1 THEN ts END) AS DATE) AS finished, max(CASE WHEN event_id % 2 = 1 THEN ts END) IS NOT NULL AND NOT coalesce(arg_max(value > 90, CASE WHEN event_id % 2 = 1 THEN ts END), false) AS ok FROM events GROUP BY user_id",
    "ledger_append": "SELECT event_type AS k, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY event_type",
    "chi2_tails": f"WITH o AS (SELECT o_orderkey AS id, o_totalprice / 20000 AS x, 2 * (1 + o_orderkey % 6) AS df FROM orders) SELECT id, round({_CHI}, 8) AS p FROM o",
    "cpcv_splits": "WITH x AS (SELECT DISTINCT k - 1 AS k FROM rets), n AS (SELECT max(k) + 1 AS n FROM x), f AS (SELECT k, CASE WHEN k < (n % 6) * (n // 6 + 1) THEN k // (n // 6 + 1) ELSE n % 6 + (k - (n % 6) * (n // 6 + 1)) // (n // 6) END AS fold FROM x, n), e AS (SELECT fold, min(k) AS lo, max(k) AS hi FROM f GROUP BY fold), s AS (SELECT row_number() OVER (ORDER BY a.fold, b.fold) - 1 AS split, a.fold AS a, b.fold AS b, a.lo AS alo, a.hi AS ahi, b.lo AS blo, b.hi AS bhi FROM e a JOIN e b ON a.fold < b.fold) SELECT CAST(split AS INT) AS split, count_if(fold IN (a, b)) AS test, count_if(NOT (k BETWEEN alo - 1 AND ahi + 1 OR k BETWEEN blo - 1 AND bhi + 1)) AS train, CAST(sum(CASE WHEN fold IN (a, b) THEN k END) AS BIGINT) AS checksum FROM f, s GROUP BY split",
    "decision_rules": "SELECT symbol AS key, 'skill' AS slot, CASE WHEN avg(r) / stddev_samp(r) < 0 THEN 'none' WHEN avg(r) / stddev_samp(r) < 0.1 THEN 'weak' ELSE 'some' END AS verdict FROM small GROUP BY symbol",
    "triage_first_of_class": "SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) > 1 AS duplicate, min(doc_id) OVER (PARTITION BY source, lang) AS representative FROM documents",
    "spearman_divergence": f"WITH {series.OBV}, x AS (SELECT symbol, ts, count(close) {series.over(-W + 1)} AS n, list(close) {series.over(-W + 1)} AS a, list(o) {series.over(-W + 1)} AS b FROM obv), y AS (SELECT symbol, ts, CASE WHEN n = {W} THEN {_RANK.replace('L', 'a')} END AS a, CASE WHEN n = {W} THEN {_RANK.replace('L', 'b')} END AS b FROM x), u AS (SELECT symbol, ts, unnest(a) AS a, unnest(b) AS b FROM y WHERE a IS NOT NULL), c AS (SELECT symbol, ts, corr(a, b) AS c FROM u GROUP BY symbol, ts) SELECT y.symbol, y.ts, round(c, 6) AS corr FROM y LEFT JOIN c ON y.symbol = c.symbol AND y.ts = c.ts",
    "standardize_expanding": f"WITH x AS (SELECT symbol, ts, ret, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s, count(ret) OVER w AS c FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT symbol, ts, round(CASE WHEN c >= 2 AND s > {series.TOL} * greatest(abs(m), 1.0) THEN greatest(-5.0, least(5.0, (ret - m) / s)) END, 8) AS z FROM x",
    "standardize_rank_expanding": "WITH x AS (SELECT a.symbol, a.ts, a.ret, count(b.ret) AS n, count_if(b.ret < a.ret) AS lo, count_if(b.ret = a.ret) AS eq FROM rets a LEFT JOIN rets b ON a.symbol = b.symbol AND b.k < a.k GROUP BY a.symbol, a.ts, a.ret) SELECT symbol, ts, round(CASE WHEN n >= 2 AND ret IS NOT NULL THEN 2 * (lo + 0.5 * eq) / n - 1 END, 8) AS score FROM x",
    "mdd_scaling_check": "WITH h AS (SELECT unnest([12, 24, 48]) AS horizon), b AS (SELECT symbol, horizon, (row_number() OVER (PARTITION BY symbol, horizon ORDER BY ts) - 1) AS k, r FROM small, h), w AS (SELECT symbol, horizon, k // horizon AS b, k, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, horizon, k // horizon ORDER BY k)) AS w FROM b), d AS (SELECT symbol, horizon, b, 1 - w / greatest(1.0, max(w) OVER (PARTITION BY symbol, horizon, b ORDER BY k)) AS d FROM w), m AS (SELECT symbol, horizon, b, max(d) AS m, count(*) AS n FROM d GROUP BY ALL) SELECT symbol, horizon, count(*) AS blocks, round(avg(m), 8) AS mean_mdd FROM m WHERE n = horizon GROUP BY symbol, horizon",
    "annual_drawdowns": "WITH w AS (SELECT symbol, year(ts) AS y, ts, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, year(ts) ORDER BY ts)) AS w FROM small), d AS (SELECT symbol, y, 1 - w / max(w) OVER (PARTITION BY symbol, y ORDER BY ts) AS d FROM w) SELECT symbol, CAST(y AS INT) AS year, count(*) AS n, round(max(d), 8) AS max_drawdown FROM d GROUP BY symbol, y HAVING count(*) >= 2",
    "cross_fit_residuals": f"WITH p AS (SELECT *, month(cluster) % 4 AS fold FROM ({PLR})), f AS (SELECT a.fold, regr_slope(b.y, b.x1) AS sy, regr_intercept(b.y, b.x1) AS iy, regr_slope(b.d, b.x1) AS sd, regr_intercept(b.d, b.x1) AS id FROM (SELECT DISTINCT fold FROM p) a JOIN p b ON b.fold <> a.fold GROUP BY a.fold), e AS (SELECT p.fold, y - iy - sy * x1 AS ey, d - id - sd * x1 AS ed FROM p JOIN f ON p.fold = f.fold) SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(sum(ed * ey) / sum(ed * ed), 5) AS theta FROM e GROUP BY fold",
    "panel_build": "WITH m AS (SELECT symbol, ts AS month, ln(close) AS p FROM bars), s AS (SELECT symbol, month, lag(p, 1) OVER w - lag(p, 12) OVER w AS mom, p - lag(p) OVER w AS rev, lead(p) OVER w - p AS fwd_ret FROM m WINDOW w AS (PARTITION BY symbol ORDER BY month)), v AS (SELECT *, stddev_samp(rev) OVER (PARTITION BY symbol ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS vol, (sum(mom) OVER (PARTITION BY month) - coalesce(mom, 0)) / nullif(count(mom) OVER (PARTITION BY month) - CASE WHEN mom IS NULL THEN 0 ELSE 1 END, 0) AS other_mom FROM s) SELECT symbol, month, round(mom, 8) AS mom, round(rev, 8) AS rev, round(fwd_ret, 8) AS fwd_ret, round(vol, 8) AS vol, round(other_mom, 8) AS other_mom FROM v",
    "sector_deciles": "WITH x AS (SELECT symbol, ts, ret, CASE WHEN symbol < 'G' THEN 'a' ELSE 'b' END AS sector FROM rets WHERE ret IS NOT NULL), r AS (SELECT *, greatest(1, round_even(count(*) OVER (PARTITION BY ts, sector) * 0.3, 0)) AS n, row_number() OVER (PARTITION BY ts, sector ORDER BY ret DESC, symbol) AS hi, row_number() OVER (PARTITION BY ts, sector ORDER BY ret, symbol DESC) AS lo FROM x) SELECT symbol, ts, CASE WHEN hi <= n THEN 'long' WHEN lo <= n THEN 'short' ELSE 'flat' END AS leg FROM r",
    "basket_hedge": "WITH x AS (SELECT a.symbol, a.ts, a.ret, m.mkt FROM rets a JOIN (SELECT ts, avg(ret) AS mkt FROM rets GROUP BY ts) m ON a.ts = m.ts WHERE a.ret IS NOT NULL), b AS (SELECT symbol, ts, CASE WHEN count(*) OVER w >= 10 THEN covar_samp(ret, mkt) OVER w / nullif(var_samp(mkt) OVER w, 0) END AS beta FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)), s AS (SELECT ts, coalesce(sum(0.5 * beta), 0) AS basket_beta FROM b GROUP BY ts) SELECT ts, round(basket_beta, 8) AS basket_beta, round(greatest(-2.0, least(2.0, 0.0 - basket_beta)), 8) AS hedge FROM s",
    "threshold_policy": "SELECT symbol, ts, CASE WHEN abs(ret) / (1 + abs(ret)) >= 0.3 THEN sign(ret) * 0.5 ELSE 0.0 END AS weight FROM rets WHERE ret IS NOT NULL",
    "simulate_contracts": "WITH s AS (SELECT symbol, ts, close, ret, round_even(sign(ret) * 10000000 / (close * 50), 0) * close * 50 / 10000000 AS held FROM rets WHERE ret IS NOT NULL), t AS (SELECT *, lag(held) OVER w AS before, abs(held - coalesce(lag(held) OVER w, 0)) * 60 / (close * 50) AS cost FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, ts, round(coalesce(before, 0) * ret - coalesce(lag(cost) OVER (PARTITION BY symbol ORDER BY ts), 0) + 0.0, 8) AS pnl FROM t",
    "event_window_rows": "SELECT symbol, ts, coalesce(max(CASE WHEN ret > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) = 1, false) AS inside FROM rets",
    "memorization_probe": "WITH x AS (SELECT doc_id % 2 = 0 AS pre, CASE WHEN doc_id % 3 > 0 AND n_chars > 0 THEN (doc_id % 7) / 50.0 * 100 END AS e FROM documents), s AS (SELECT count_if(pre) AS n_pre, count(CASE WHEN pre THEN e END) AS answered_pre, quantile_cont(CASE WHEN pre THEN e END, 0.5) AS mp, count_if(NOT pre) AS n_post, count(CASE WHEN NOT pre THEN e END) AS answered_post, quantile_cont(CASE WHEN NOT pre THEN e END, 0.5) AS mq FROM x) SELECT n_pre, answered_pre, round(mp, 6) AS median_pre, n_post, answered_post, round(mq, 6) AS median_post, coalesce(answered_pre > 0 AND answered_pre >= 0.5 * n_pre AND mp < 3 AND (mq IS NULL OR mp < 0.5 * mq), false) AS leak_suspected FROM s",
    "trim_tail_zeros": "WITH x AS (SELECT symbol, ts, max(CASE WHEN k <= 60 AND ret <> 0 THEN ts END) OVER (PARTITION BY symbol) AS l FROM rets) SELECT symbol, ts FROM x WHERE ts <= l",
    "front_contract": "WITH v AS (SELECT event_type AS root, CAST(ts AS DATE) AS d, user_id AS expiry, sum(value) AS volume FROM events GROUP BY 1, 2, 3) SELECT root, d, expiry FROM (SELECT *, row_number() OVER (PARTITION BY root, d ORDER BY volume DESC, expiry) AS i FROM v) WHERE i = 1",
}


def _duck(text: str) -> str:
    """DuckDB text as it stands, with the views it names before it."""
    return spell(expand(text), True)


ORACLES = {name: _duck(text) for name, text in RAW.items()}
