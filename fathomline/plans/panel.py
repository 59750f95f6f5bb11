"""Validation statistics, joins, aggregations and causal estimates."""

from __future__ import annotations

MOM = "mo AS (SELECT symbol, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM small GROUP BY symbol), ce AS (SELECT s.symbol, ts, row_number() OVER (PARTITION BY s.symbol ORDER BY ts) AS i, r - m AS c, n, m, sd FROM small s JOIN mo ON s.symbol = mo.symbol)"
LAGS = range(1, 11)
#: Autocovariance sums g0 to g10 and autocorrelations p1 to p10: one window over lagged values, no self-join.
ACF = f"{MOM}, lg AS (SELECT symbol, n, c{''.join(f', lag(c, {k}) OVER (PARTITION BY symbol ORDER BY i) AS c{k}' for k in LAGS)} FROM ce), ac AS (SELECT symbol, max(n) AS n, sum(c * c) AS g0{''.join(f', coalesce(sum(c * c{k}), 0) AS g{k}' for k in LAGS)} FROM lg GROUP BY symbol), rho AS (SELECT *{''.join(f', g{k} / nullif(g0, 0) AS p{k}' for k in LAGS)} FROM ac)"
_Q10 = "n * (n + 2) * (" + " + ".join(f"p{k} * p{k} / (n - {k})" for k in LAGS) + ")"


def chi2_tail_even(q: str, df: int) -> str:
    """Upper tail of chi-square with an even number of degrees of freedom: a finite sum."""
    terms, fact = [], 1
    for i in range(df // 2):
        fact *= max(i, 1)
        terms.append(f"power({q} / 2, {i}) / {fact}.0")
    return f"exp(-({q}) / 2) * ({' + '.join(terms)})"


# Coefficients of the published rational approximation of erfc (relative error under 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_two_sided(z: str) -> str:
    """Chance that a standard normal value is further from 0 than z."""
    x = f"(abs({z}) * 0.7071067811865476)"
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = f"{_ERFC[-1]}"
    for c in _ERFC[-2::-1]:
        poly = f"({c} + {t} * {poly})"
    return f"least(1.0, {t} * exp(-{x} * {x} + {poly}))"


#: Variance ratios for q = 2, 4, 8, 16, with the heteroskedasticity-robust variance of each.
QS = (2, 4, 8, 16)
_LAG16 = range(1, 16)
VR = (
    f"vl AS (SELECT symbol, n, i, c{''.join(f', lag(c, {k}) OVER (PARTITION BY symbol ORDER BY i) AS c{k}' for k in _LAG16)}{''.join(f', sum(c) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {q - 1} PRECEDING AND CURRENT ROW) AS b{q}' for q in QS)} FROM ce), "
    f"vs AS (SELECT symbol, CAST(max(n) AS DOUBLE) AS n, sum(c * c) AS g0{''.join(f', sum(c * c * c{k} * c{k}) AS h{k}' for k in _LAG16)}{''.join(f', sum(CASE WHEN i >= {q} THEN b{q} * b{q} END) AS e{q}' for q in QS)} FROM vl GROUP BY symbol), "
    "vq AS (" + " UNION ALL ".join(f"SELECT symbol, n, CAST({q} AS DOUBLE) AS q, e{q} / ({q}.0 * (n - {q} + 1) * (1 - {q}.0 / n)) / (g0 / (n - 1)) AS vr, " + " + ".join(f"{(2 * (q - k) / q) ** 2!r} * h{k} / (g0 * g0)" for k in range(1, q)) + " AS th FROM vs" for q in QS) + ")"
)
ISLANDS = "fl AS (SELECT symbol, d, CASE WHEN $days(PREV) > 2 THEN 1 WHEN lag(d) OVER (PARTITION BY symbol ORDER BY d) IS NULL THEN 1 ELSE 0 END AS new FROM flags), ep AS (SELECT symbol, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM (SELECT symbol, d, sum(new) OVER (PARTITION BY symbol ORDER BY d) AS island FROM fl) GROUP BY symbol, island)"
RESID = "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS cluster, l_extendedprice / l_quantity AS y, l_discount AS d, l_tax AS x1, l_quantity AS x2 FROM lineitem"
#: Frisch-Waugh-Lovell by one pass of covariances (a row of coefficients), then one pass of residuals by cluster.
FWL = (
    f"p AS ({RESID}), s AS (SELECT count(*) AS n, avg(y) AS my, avg(d) AS md, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, covar_pop(x1, x2) AS s12, var_pop(x2) AS s22, covar_pop(x1, y) AS y1, covar_pop(x2, y) AS y2, covar_pop(x1, d) AS d1, covar_pop(x2, d) AS d2, covar_pop(d, y) AS dy, var_pop(d) AS dd FROM p), "
    "b AS (SELECT *, (y1 * s22 - y2 * s12) / (s11 * s22 - s12 * s12) AS by1, (y2 * s11 - y1 * s12) / (s11 * s22 - s12 * s12) AS by2, (d1 * s22 - d2 * s12) / (s11 * s22 - s12 * s12) AS bd1, (d2 * s11 - d1 * s12) / (s11 * s22 - s12 * s12) AS bd2 FROM s), "
    "t AS (SELECT *, (dy - bd1 * y1 - bd2 * y2) / (dd - bd1 * d1 - bd2 * d2) AS theta, n * (dd - bd1 * d1 - bd2 * d2) AS sdd FROM b), "
    "e AS (SELECT cluster, t.n, theta, sdd, y - my - by1 * (x1 - m1) - by2 * (x2 - m2) AS ey, d - md - bd1 * (x1 - m1) - bd2 * (x2 - m2) AS ed FROM p CROSS JOIN t)"
)

SQL = {
    "annualized_sharpe": "SELECT symbol, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12), 8) AS sharpe FROM small GROUP BY symbol",
    "sharpe_moments": f"WITH {MOM} SELECT symbol, max(n) AS n, round(max(m) / nullif(max(sd), 0), 8) AS sr, round(avg(c * c * c) / nullif(power(avg(c * c), 1.5), 0), 6) AS skew, round(avg(c * c * c * c) / nullif(power(avg(c * c), 2), 0), 6) AS kurt FROM ce GROUP BY symbol",
    "min_track_record_length": f"WITH {MOM}, q AS (SELECT symbol, max(m) / max(sd) AS sr, avg(c * c * c) / power(avg(c * c), 1.5) AS sk, avg(c * c * c * c) / power(avg(c * c), 2) AS ku FROM ce GROUP BY symbol) SELECT symbol, round(CASE WHEN sr > 0.01 THEN 1 + (1 - sk * sr + (ku - 1) / 4 * sr * sr) * power(1.6448536269514722 / (sr - 0.01), 2) END, 4) AS min_trl FROM q",
    "variance_ratio": f"WITH {MOM}, {VR}, z AS (SELECT symbol, q, vr, (vr - 1) / sqrt(2 * (2 * q - 1) * (q - 1) / (3 * q * n)) AS z, (vr - 1) / sqrt(nullif(th, 0)) AS z_het FROM vq) SELECT symbol, q, round(vr, 8) AS vr, round(z, 6) AS z, round({normal_two_sided('z')}, 6) AS p, round(z_het, 6) AS z_het, round({normal_two_sided('z_het')}, 6) AS p_het FROM z",
    "ljung_box": f"WITH {ACF}, q AS (SELECT symbol, {_Q10} AS q FROM rho) SELECT symbol, round(q, 6) AS q10, round({chi2_tail_even('q', 10)}, 8) AS p FROM q",
    "runs_test": f"WITH s AS (SELECT symbol, sign(r) AS s, lag(sign(r)) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM small WHERE r <> 0), q AS (SELECT symbol, 1 + count_if(s <> p) AS runs, CAST(count_if(s > 0) AS DOUBLE) AS a, CAST(count_if(s < 0) AS DOUBLE) AS b FROM s GROUP BY symbol), z AS (SELECT symbol, runs, (runs - (2 * a * b / (a + b) + 1)) / sqrt(2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1))) AS z FROM q) SELECT symbol, runs, round(z, 8) AS z, round({normal_two_sided('z')}, 6) AS p FROM z",
    "permutation_entropy": "WITH x AS (SELECT symbol, r AS a, lead(r, 1) OVER (PARTITION BY symbol ORDER BY ts) AS b, lead(r, 2) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM small), p AS (SELECT symbol, concat(CASE WHEN a <= b THEN '1' ELSE '0' END, CASE WHEN b <= c THEN '1' ELSE '0' END, CASE WHEN a <= c THEN '1' ELSE '0' END) AS code FROM x WHERE c IS NOT NULL), n AS (SELECT symbol, code, count(*) AS k FROM p GROUP BY symbol, code) SELECT symbol, round(-sum(k * 1.0 / t * ln(k * 1.0 / t)) / ln(6), 8) AS entropy FROM (SELECT *, sum(k) OVER (PARTITION BY symbol) AS t FROM n) GROUP BY symbol",
    "hurst_rs": "WITH s AS (SELECT sz FROM (SELECT 8 AS sz UNION ALL SELECT 12 UNION ALL SELECT 16 UNION ALL SELECT 24)), b AS (SELECT symbol, sz, CAST(floor((i - 1) / sz) AS BIGINT) AS blk, i, r FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, r FROM small) CROSS JOIN s), f AS (SELECT *, avg(r) OVER (PARTITION BY symbol, sz, blk) AS m, count(*) OVER (PARTITION BY symbol, sz, blk) AS c FROM b), y AS (SELECT *, sum(r - m) OVER (PARTITION BY symbol, sz, blk ORDER BY i) AS z FROM f WHERE c = sz), rs AS (SELECT symbol, sz, blk, (max(z) - min(z)) / nullif(stddev_samp(r), 0) AS v FROM y GROUP BY symbol, sz, blk), a AS (SELECT symbol, ln(sz) AS x, ln(avg(v)) AS y FROM rs GROUP BY symbol, sz) SELECT symbol, round(regr_slope(y, x), 8) AS hurst FROM a GROUP BY symbol HAVING count(*) = 4",
    "t_test": "SELECT symbol, count(*) AS n, round(avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0), 8) AS t FROM small GROUP BY symbol",
    "newey_west_t": f"WITH {ACF}, v AS (SELECT symbol, n, (g0 + {' + '.join(f'2 * (1 - {k} / 6.0) * g{k}' for k in range(1, 6))}) / n AS lrv FROM rho), w AS (SELECT v.symbol, mo.m / sqrt(lrv / v.n) AS t FROM v JOIN mo ON v.symbol = mo.symbol) SELECT symbol, round(t, 8) AS t, round({normal_two_sided('t')}, 6) AS p FROM w",
    "cohens_d": "SELECT symbol, round(avg(r) / nullif(stddev_samp(r), 0), 8) AS d, round(avg(r) / nullif(stddev_samp(r), 0) - 1.959963984540054 / sqrt(count(*)), 8) AS low, round(avg(r) / nullif(stddev_samp(r), 0) + 1.959963984540054 / sqrt(count(*)), 8) AS high FROM small GROUP BY symbol",
    "holm_bonferroni": f"WITH {ACF}, q AS (SELECT symbol, {_Q10} AS q FROM rho), t AS (SELECT symbol, {chi2_tail_even('q', 10)} AS p FROM q), o AS (SELECT *, row_number() OVER (ORDER BY p, symbol) AS k, count(*) OVER () AS m FROM t) SELECT symbol, round(p, 8) AS p, round(least(1.0, p * m), 8) AS bonferroni, round(max(least(1.0, p * (m - k + 1))) OVER (ORDER BY k), 8) AS holm FROM o",  # a row a test
    "n_effective": f"WITH {ACF} SELECT symbol, floor(n / greatest(1.0, 1 + 2 * ({' + '.join(f'CASE WHEN p{k} > 0 THEN p{k} ELSE 0 END' for k in LAGS)}))) AS n_eff FROM rho",
    "jarque_bera": f"WITH {MOM}, q AS (SELECT symbol, max(n) AS n, avg(c * c * c) / power(avg(c * c), 1.5) AS sk, avg(c * c * c * c) / power(avg(c * c), 2) AS ku FROM ce GROUP BY symbol) SELECT symbol, round(n / 6.0 * (sk * sk + (ku - 3) * (ku - 3) / 4), 6) AS jb, round(exp(-n / 12.0 * (sk * sk + (ku - 3) * (ku - 3) / 4)), 8) AS p FROM q",
    "effective_n_trials": "WITH z AS (SELECT symbol, ts, (r - avg(r) OVER (PARTITION BY symbol)) / stddev_pop(r) OVER (PARTITION BY symbol) AS z FROM small), c AS (SELECT a.symbol AS a, b.symbol AS b, avg(a.z * b.z) AS rho FROM z a JOIN z b ON a.ts = b.ts GROUP BY a.symbol, b.symbol) SELECT round(count(DISTINCT a) * count(DISTINCT a) / sum(rho * rho), 6) AS n_eff FROM c",
    "dsr_sr_variance": "WITH s AS (SELECT symbol, avg(r) / stddev_samp(r) AS sr, count(*) AS n FROM small GROUP BY symbol) SELECT round(greatest(1.0 / (max(n) - 1), var_samp(sr)), 10) AS variance FROM s",
    "block_sharpes": "WITH b AS (SELECT symbol, ntile(6) OVER (PARTITION BY symbol ORDER BY ts) AS blk, r FROM small) SELECT symbol, blk, round(CASE WHEN count(*) > 1 THEN avg(r) / nullif(stddev_samp(r), 0) END, 8) AS sharpe FROM b GROUP BY symbol, blk",
    "pbo": "WITH b AS (SELECT symbol, ntile(4) OVER (PARTITION BY symbol ORDER BY ts) AS blk, r FROM small), s AS (SELECT symbol, blk, count(*) AS n, sum(r) AS x FROM b GROUP BY symbol, blk), c AS (SELECT a.v AS p, b.v AS q FROM (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) a JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) b ON a.v < b.v), m AS (SELECT p, q, symbol, sum(CASE WHEN blk IN (p, q) THEN x END) / sum(CASE WHEN blk IN (p, q) THEN n END) AS ins, sum(CASE WHEN blk NOT IN (p, q) THEN x END) / sum(CASE WHEN blk NOT IN (p, q) THEN n END) AS oos FROM s CROSS JOIN c GROUP BY p, q, symbol), k AS (SELECT *, row_number() OVER (PARTITION BY p, q ORDER BY ins DESC, symbol) AS best, cume_dist() OVER (PARTITION BY p, q ORDER BY oos) * count(*) OVER (PARTITION BY p, q) / (count(*) OVER (PARTITION BY p, q) + 1) AS w FROM m) SELECT count(*) AS splits, round(avg(CASE WHEN ln(w / (1 - w)) <= 0 THEN 1.0 ELSE 0.0 END), 8) AS pbo FROM k WHERE best = 1",
    "purged_kfold": "WITH x AS (SELECT k, CAST(floor((k - 1) * 5 / n) AS BIGINT) AS fold FROM (SELECT k, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM rets))), b AS (SELECT fold, min(k) AS lo, max(k) AS hi FROM x GROUP BY fold) SELECT b.fold, count_if(x.k BETWEEN lo AND hi) AS test, count_if(x.k < lo - 2 OR x.k > hi + 2) AS train FROM b CROSS JOIN x GROUP BY b.fold",
    "walkforward_folds": "WITH s AS (SELECT explode_me AS i FROM (SELECT 0 AS explode_me UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)), r AS (SELECT i, k, r, symbol FROM small CROSS JOIN s) SELECT symbol, i AS fold, count_if(k <= 24 + 12 * i) AS train, count_if(k BETWEEN 26 + 12 * i AND 37 + 12 * i) AS test, round(avg(CASE WHEN k BETWEEN 26 + 12 * i AND 37 + 12 * i THEN r END), 10) AS test_mean FROM r GROUP BY symbol, i",
    "complexity_gap_correlations": "WITH z AS (SELECT symbol, ts, (r - avg(r) OVER (PARTITION BY symbol)) / stddev_pop(r) OVER (PARTITION BY symbol) AS z FROM small) SELECT a.symbol AS a, b.symbol AS b, round(avg(a.z * b.z), 8) AS rho FROM z a JOIN z b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol",
    # aggregations
    "count_by_source": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "count_distinct_composite": "SELECT count(DISTINCT concat(source, '|', CAST(doc_id AS STRING))) AS n FROM documents",
    "null_rate_by_year": "WITH x AS (SELECT o.o_orderkey, year(o.o_orderdate) AS y, l.l_orderkey AS v FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON o.o_orderkey = l.l_orderkey) SELECT y, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_rate FROM x GROUP BY y UNION ALL SELECT NULL, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 4) FROM x",
    "liquid_universe": "WITH u AS (SELECT symbol, median(volume) AS med, max(close) FILTER (WHERE k = 1) AS first_close, any_value(symbol) AS name FROM rets GROUP BY symbol HAVING count(*) >= 12), t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY med DESC, symbol) AS place FROM u) WHERE place <= 4) SELECT symbol, round(med, 4) AS med, first_close FROM t WHERE first_close >= 1000",
    "trailing_universe": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars WHERE ts <= DATE '2000-12-31'), q AS (SELECT symbol, median(volume) AS med, max(CASE WHEN back = 1 THEN close END) AS last_close, count(*) AS n FROM t WHERE back <= 12 GROUP BY symbol) SELECT symbol, round(med, 4) AS med, last_close FROM q WHERE n >= 6 AND last_close >= 1000 AND med >= 100000 ORDER BY med DESC, symbol LIMIT 4",
    "hourly_bars": "SELECT symbol, CAST(ts AS STRING) AS hour, close, high, low, round(volume, 6) AS volume, n FROM hourly",
    "episodes": f"WITH {ISLANDS} SELECT symbol, first_day, last_day, days FROM ep",
    "episode_feasibility": f"WITH {ISLANDS} SELECT count(*) AS episodes, count(DISTINCT symbol) AS symbols, median(days) AS median_days, round(avg(CASE WHEN days >= 3 THEN 1.0 ELSE 0.0 END), 8) AS long_share FROM ep",
    "variant_summary": "SELECT symbol, count(*) AS n, round(avg(r) * 10000, 6) AS mean_bps, round(avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0), 8) AS t, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 8) AS hit_rate FROM small GROUP BY symbol",
    "by_year_t": "SELECT year(ts) AS y, count(*) AS n, round(avg(r) * 10000, 6) AS mean_bps, round(CASE WHEN count(*) > 2 THEN avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0) END, 8) AS t FROM small GROUP BY 1",
    "cost_break_even": "WITH c AS (SELECT 0 AS bps UNION ALL SELECT 5 UNION ALL SELECT 10 UNION ALL SELECT 20 UNION ALL SELECT 40 UNION ALL SELECT 80) SELECT bps, round(avg(r - bps / 10000.0), 10) AS net FROM small CROSS JOIN c GROUP BY bps",
    "weekly_bucket_mean": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, round(avg(value), 8) AS mean FROM events GROUP BY 1",
    "gap_percentiles": "SELECT " + ", ".join(f"round($pct(value, {p}), 6) AS p{str(p)[2:]}" for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", min(value) AS low, max(value) AS high, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd FROM events",
    "value_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type",
    "perf_summary": "WITH m AS (SELECT symbol, max(d) AS mdd FROM dd GROUP BY symbol) SELECT e.symbol, round($days(SPAN) / 365.25, 6) AS years, round(power(max_by(w, k), 365.25 / $days(SPAN)) - 1, 8) AS cagr, round(stddev_samp(r) * sqrt(12), 8) AS vol, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12), 8) AS sharpe, round(max(mdd), 8) AS max_drawdown, count_if(abs(r) > 0.005) AS n_tx FROM equity e JOIN m ON e.symbol = m.symbol GROUP BY e.symbol",
    "last_wins": "SELECT user_id, max_by(event_type, event_id) AS disposition, sum(1) AS trials FROM events GROUP BY user_id",
    "disposition_counter": "WITH l AS (SELECT user_id, max_by(event_type, event_id) AS disposition, max_by(value, event_id) AS v FROM events GROUP BY user_id) SELECT disposition, count(*) AS n, round(sum(v), 6) AS delta_n, count_if(v > 50) AS n_claim FROM l GROUP BY disposition",
    # joins
    "left_join_override": "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'auto' WHEN l.quality = 1 THEN 'factor' ELSE 'strategy' END AS kind FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "anti_join_frontier": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "semi_join_scope": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "asof_backward": "WITH c AS (SELECT symbol, ts, lag(v, 1) OVER (PARTITION BY symbol ORDER BY ts) AS shifted FROM (SELECT symbol, date_trunc('day', ts) AS ts, sum(value) AS v FROM (SELECT event_type AS symbol, ts, value FROM events) GROUP BY 1, 2)), u AS (SELECT symbol, ts, CAST(NULL AS DOUBLE) AS v, 1 AS side FROM hourly UNION ALL SELECT symbol, ts, shifted AS v, 0 AS side FROM c) SELECT symbol, CAST(ts AS STRING) AS ts, round(v, 6) AS coarse FROM (SELECT symbol, ts, side, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM u) WHERE side = 1",
    "asof_with_default": "SELECT d.symbol, d.d, coalesce(o.w, 1.0) AS weight FROM daily d LEFT JOIN (SELECT symbol, d, least(1.0, greatest(0.0, round(v / 100, 6))) AS w FROM daily WHERE n >= 70) o ON d.symbol = o.symbol AND d.d = o.d",
    # only each year's first five can be among the first five of a later day
    "pit_topk": "WITH p AS (SELECT year, doc_id, n_chars FROM (SELECT year, doc_id, n_chars, row_number() OVER (PARTITION BY year ORDER BY n_chars DESC, doc_id) AS place FROM papers) WHERE place <= 5) SELECT day, doc_id, n_chars FROM (SELECT q.day, p.doc_id, p.n_chars, row_number() OVER (PARTITION BY q.day ORDER BY p.n_chars DESC, p.doc_id) AS place FROM (SELECT DISTINCT year AS day FROM p) q JOIN p ON p.year <= q.day - 1) WHERE place <= 5",
    "event_window": f"WITH {ISLANDS}, s AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM daily)), m AS (SELECT d, avg(v) AS v FROM daily GROUP BY d), w AS (SELECT e.symbol, e.first_day, s.i - z.i AS u, m.v FROM ep e JOIN s z ON e.first_day = z.d JOIN s ON s.i BETWEEN z.i - 3 AND z.i + 5 JOIN m ON m.d = s.d) SELECT u, count(*) AS n, round(avg(v), 8) AS car FROM w GROUP BY u",
    # a day is clean unless a flag is within 3 sessions: flags spread over their neighbourhood, then an anti join by key
    "clean_controls": "WITH s AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM flags)), f AS (SELECT flags.symbol, s.i FROM flags JOIN s ON flags.d = s.d), near AS (SELECT DISTINCT symbol, i + o AS i FROM (SELECT symbol, i, $explode($offsets) AS o FROM f)), g AS (SELECT a.symbol, s.d, s.i FROM (SELECT DISTINCT symbol FROM flags) a CROSS JOIN s) SELECT g.symbol, g.d FROM g LEFT ANTI_JOIN near ON g.symbol = near.symbol AND g.i = near.i",
    "matched_controls": "WITH x AS (SELECT symbol, ts, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS a, lag(volume) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM rets), z AS (SELECT symbol, ts, ret, (a - avg(a) OVER (PARTITION BY ts)) / nullif(stddev_samp(a) OVER (PARTITION BY ts), 0) AS a, (b - avg(b) OVER (PARTITION BY ts)) / nullif(stddev_samp(b) OVER (PARTITION BY ts), 0) AS b FROM x WHERE a IS NOT NULL), f AS (SELECT * FROM z WHERE ret > 2), c AS (SELECT * FROM z WHERE NOT ret > 2) SELECT symbol, ts, control, round(dist, 8) AS dist FROM (SELECT x.symbol, x.ts, y.symbol AS control, (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) AS dist, row_number() OVER (PARTITION BY x.symbol, x.ts ORDER BY (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b), y.symbol) AS place FROM f x JOIN c y ON x.ts = y.ts) WHERE place <= 10",
    "calendar_alignment": "SELECT c.d, v.symbol, round(coalesce(x.v, 0), 8) AS v FROM (SELECT DISTINCT d FROM daily) c CROSS JOIN (SELECT DISTINCT symbol FROM daily) v LEFT JOIN (SELECT * FROM daily WHERE n > 60) x ON x.d = c.d AND x.symbol = v.symbol",
    "upsert_counts": "SELECT count_if(b.k IS NULL) AS inserted, count_if(b.k IS NOT NULL AND n.k IS NOT NULL) AS updated, count_if(n.k IS NULL) AS untouched FROM (SELECT doc_id AS k FROM documents) b FULL OUTER JOIN (SELECT doc_id AS k FROM labels) n ON b.k = n.k",
    "union_distinct_dates": "SELECT d FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem)",
    "intersect_keys": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "except_keys": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "keep_first": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1",
    # causal
    "plr_effect": f"WITH {FWL}, g AS (SELECT cluster, max(n) AS n, max(theta) AS theta, max(sdd) AS sdd, sum(ed * (ey - theta * ed)) AS s, sum(ed * ed * (ey - theta * ed) * (ey - theta * ed)) AS q FROM e GROUP BY cluster) SELECT max(n) AS n, round(max(theta), 6) AS theta, round(sqrt(sum(q)) / max(sdd), 6) AS se, count(*) AS clusters, round(sqrt(sum(s * s) * count(*) / (count(*) - 1)) / max(sdd), 6) AS se_cluster FROM g",
    "fama_macbeth": f"WITH p AS ({RESID}), b AS (SELECT cluster, regr_slope(y, d) AS beta FROM p GROUP BY cluster HAVING count(*) >= 30) SELECT count(*) AS periods, round(avg(beta), 6) AS beta, round(avg(beta) / (stddev_samp(beta) / sqrt(count(*))), 6) AS t FROM b",
    "time_block_signs": f"WITH p AS ({RESID}), b AS (SELECT cluster, regr_slope(y, d) AS beta FROM p GROUP BY cluster HAVING count(*) >= 30), k AS (SELECT ntile(10) OVER (ORDER BY cluster) AS blk, beta FROM b) SELECT blk, count(*) AS periods, sign(avg(beta)) AS s FROM k GROUP BY blk",
}

# Differences of days differ in the order of their arguments.
_PREV = ("d, lag(d) OVER (PARTITION BY symbol ORDER BY d)", "lag(d) OVER (PARTITION BY symbol ORDER BY d), d")
_SPAN = ("max(ts), min(ts)", "min(ts), max(ts)")


def sql(name: str, duck: bool) -> str:
    text = SQL[name].replace("LEFT ANTI_JOIN", "ANTI JOIN" if duck else "LEFT ANTI JOIN").replace("$offsets", "range(-3, 4)" if duck else "sequence(-3, 3)")
    return text.replace("PREV", _PREV[duck]).replace("SPAN", _SPAN[duck])
