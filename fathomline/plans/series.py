"""Price-volume factors, multi-scale operators, drawdown and risk: windows over one symbol's series.

Frames end at t-1 where a sample must not hold the value it judges, and full windows are enforced by counts.
"""

from __future__ import annotations

from math import exp

P = "PARTITION BY symbol ORDER BY ts"


def over(lo: int, hi: int = 0) -> str:
    side = lambda n: "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"
    return f"OVER ({P} ROWS BETWEEN {side(lo)} AND {side(hi)})"


def full(expr: str, w: int, of: str, lo: int | None = None, hi: int = 0) -> str:
    """expr over a window that must hold w values of `of`."""
    f = over(-(w - 1) if lo is None else lo, hi)
    return f"CASE WHEN count({of}) {f} = {w} THEN {expr} {f} END"


W = 12
#: Weights of an exponential average over 24 bars, newest first.
EWMA = [(k, exp(-k / 6)) for k in range(24)]
TOL = 1e-12
#: A missing close poisons all later values, a missing volume alike: sums are void once a term has been missing.
OBV = f"obv AS (SELECT *, CASE WHEN count(CASE WHEN term IS NULL THEN 1 END) OVER ({P}) = 0 THEN sum(term) OVER ({P}) END AS o FROM (SELECT *, CASE WHEN k = 1 AND close IS NOT NULL THEN 0.0 * volume ELSE sign(close - lag(close) OVER ({P})) * volume END AS term FROM rets))"
SLOPES = f"{OBV}, s AS (SELECT symbol, ts, {full('regr_slope(close, k)', W, 'close')} AS slope, {full('covar_pop(close, o)', W, 'o')} AS cv, {full('stddev_pop(close)', W, 'o')} AS sc, {full('stddev_pop(o)', W, 'o')} AS so FROM obv), c AS (SELECT symbol, ts, slope, greatest(-1.0, least(1.0, cv / nullif(sc * so, 0))) AS corr FROM s)"
Z = f"z AS (SELECT symbol, ts, k, volume, ln(1 + volume) AS x, avg(ln(1 + volume)) {over(-W, -1)} AS m, stddev_samp(ln(1 + volume)) {over(-W, -1)} AS s, count(*) {over(-W, -1)} AS c FROM rets), zz AS (SELECT symbol, ts, CASE WHEN c < {W} THEN NULL WHEN s > {TOL} * greatest(abs(m), 1.0) THEN (x - m) / s WHEN abs(x - m) <= {TOL} * greatest(abs(m), 1.0) THEN 0.0 END AS z FROM z)"

#: A bar without price or volume counts on neither side of the fraction.
VWAP = f"vw AS (SELECT symbol, ts, close, CASE WHEN k >= {W} THEN sum(tp * volume) {over(-W + 1)} / nullif(sum(CASE WHEN tp IS NOT NULL THEN volume END) {over(-W + 1)}, 0) END AS vwap FROM (SELECT *, (high + low + close) / 3 AS tp FROM rets))"
MODWT = (
    f"v1 AS (SELECT symbol, ts, k, r, (r + lag(r, 1, CAST(0 AS DOUBLE)) OVER ({P})) / 2 AS v, (r - lag(r, 1, CAST(0 AS DOUBLE)) OVER ({P})) / 2 AS w1 FROM small), "
    f"v2 AS (SELECT symbol, ts, k, r, w1, (v + lag(v, 2, CAST(0 AS DOUBLE)) OVER ({P})) / 2 AS v, (v - lag(v, 2, CAST(0 AS DOUBLE)) OVER ({P})) / 2 AS w2 FROM v1), "
    f"v3 AS (SELECT symbol, ts, row_number() OVER ({P}) AS i, r, w1, w2, (v + lag(v, 4, CAST(0 AS DOUBLE)) OVER ({P})) / 2 AS v3, (v - lag(v, 4, CAST(0 AS DOUBLE)) OVER ({P})) / 2 AS w3 FROM v2)"
)
EPISODES = f"e AS (SELECT *, sum(CASE WHEN d <= 0 THEN 1 ELSE 0 END) OVER ({P}) AS island FROM dd), g AS (SELECT symbol, island, min(ts) AS peak, count(*) AS bars, max(d) AS depth, min_by(ts, struct_key) AS trough, count_if(d > 0) AS under FROM (SELECT *, -d AS neg, row_number() OVER (PARTITION BY symbol, island ORDER BY d DESC, ts) AS struct_key FROM e) GROUP BY symbol, island), h AS (SELECT *, lead(peak) OVER (PARTITION BY symbol ORDER BY island) AS recovery FROM g)"
STATS = "st AS (SELECT symbol, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd, exp(sum(ln(1 + r))) AS total, sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(*)) AS down_full, sqrt(sum(CASE WHEN r < 0 THEN r * r END) / nullif(count_if(r < 0), 0)) AS down_only FROM small GROUP BY symbol), mx AS (SELECT symbol, max(d) AS mdd, sqrt(avg(d * d)) AS ulcer FROM dd GROUP BY symbol), yr AS (SELECT symbol, avg(md) AS amdd FROM (SELECT symbol, y, max(d) AS md, count(*) AS c FROM (SELECT symbol, y, 1 - w / max(w) OVER (PARTITION BY symbol, y ORDER BY ts) AS d FROM (SELECT symbol, ts, year(ts) AS y, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, year(ts) ORDER BY ts)) AS w FROM small)) GROUP BY symbol, y) WHERE c >= 2 GROUP BY symbol), ra AS (SELECT st.symbol, n, m, sd, total, down_full, down_only, mdd, ulcer, amdd, power(total, 12.0 / n) - 1 AS cagr FROM st JOIN mx ON st.symbol = mx.symbol LEFT JOIN yr ON st.symbol = yr.symbol)"

SQL = {
    "excess_volume": f"WITH {Z} SELECT symbol, ts, round(z, 8) AS z FROM zz",
    "volume_breakout": f"WITH {Z} SELECT symbol, ts, coalesce(z > 1, false) AS breakout FROM zz",
    "obv": f"WITH {OBV} SELECT symbol, ts, round(o, 4) AS obv FROM obv",
    "obv_slope": f"WITH {OBV} SELECT symbol, ts, round({full('regr_slope(o, k)', W, 'o')} / nullif(avg(volume) {over(-W + 1)}, 0), 8) AS obv_slope FROM obv",
    "price_volume_divergence": f"WITH {SLOPES} SELECT symbol, ts, round(corr, 8) AS corr FROM c",
    "divergence_flag": f"WITH {SLOPES} SELECT symbol, ts, CASE WHEN slope > 0 AND corr < 0 THEN -1 WHEN slope < 0 AND corr < 0 THEN 1 ELSE 0 END AS flag FROM c",
    "typical_price": "SELECT symbol, ts, round((high + low + close) / 3, 6) AS typical_price FROM bars",
    "rolling_vwap": f"WITH {VWAP} SELECT symbol, ts, round(vwap, 6) AS vwap FROM vw",
    "vwap_deviation": f"WITH {VWAP} SELECT symbol, ts, round(CASE WHEN vwap > 0 THEN close / vwap - 1 END, 8) AS deviation FROM vw",
    "twap": "SELECT symbol, ts, round((open + high + low + close) / 4, 6) AS twap FROM bars",
    "amihud_illiquidity": f"SELECT symbol, ts, round(CASE WHEN k >= {W} THEN 1e9 * avg(CASE WHEN volume > 0 THEN abs(ret) / volume END) {over(-W + 1)} END, 8) AS illiquidity FROM rets",
    "standardize_zscore": f"WITH x AS (SELECT symbol, ts, ret, avg(ret) {over(-W, -1)} AS m, stddev_samp(ret) {over(-W, -1)} AS s, count(ret) {over(-W, -1)} AS c FROM rets) SELECT symbol, ts, round(CASE WHEN c < 2 THEN NULL WHEN s > {TOL} * greatest(abs(m), 1.0) THEN greatest(-5.0, least(5.0, (ret - m) / s)) WHEN abs(ret - m) <= {TOL} THEN 0.0 END, 8) AS z FROM x",
    # the frame's values are carried as a list: no self-join
    "standardize_robust": f"WITH x AS (SELECT symbol, ts, ret, $pct(ret, 0.5) {over(-W, -1)} AS med, $list(ret) {over(-W, -1)} AS vs, count(ret) {over(-W, -1)} AS c FROM rets), p AS (SELECT symbol, ts, ret, med, $median_dev(vs, med) AS mad FROM x WHERE c = {W}) SELECT symbol, ts, round((ret - med) / nullif(1.4826 * mad, 0), 8) AS z FROM p",
    "standardize_rank": f"WITH x AS (SELECT symbol, ts, ret, $list(ret) {over(-W, -1)} AS vs, count(ret) {over(-W, -1)} AS c FROM rets) SELECT symbol, ts, round(2 * ($below(vs, ret) + 0.5 * $equal(vs, ret)) / c - 1, 8) AS rank_score FROM x WHERE c = {W} AND ret IS NOT NULL",
    "detrend_diff": f"SELECT symbol, ts, round(close - lag(close, 3) OVER ({P}), 6) AS diff, round(ln(close) - ln(lag(close, 3) OVER ({P})), 8) AS logdiff FROM bars",
    "detrend_ols": f"SELECT symbol, ts, round(close - ({full('regr_intercept(close, k)', W, 'close')} + {full('regr_slope(close, k)', W, 'close')} * k), 4) AS residual FROM rets",
    "rolling_ols_slope": f"SELECT symbol, ts, round({full('regr_slope(close, k)', W, 'close')}, 6) AS slope FROM rets",
    "modwt_haar": f"WITH {MODWT} SELECT symbol, ts, CASE WHEN i >= 2 THEN round(w1, 10) END AS w1, CASE WHEN i >= 4 THEN round(w2, 10) END AS w2, CASE WHEN i >= 8 THEN round(w3, 10) END AS w3, CASE WHEN i >= 8 THEN round(v3, 10) END AS v3 FROM v3",
    "scale_energy": f"WITH {MODWT}, q AS (SELECT symbol, sum(w1 * w1) AS e1, sum(w2 * w2) AS e2, sum(w3 * w3) AS e3, sum(v3 * v3) - count(*) * avg(v3) * avg(v3) AS ev FROM v3 WHERE i >= 8 GROUP BY symbol) SELECT symbol, round(e1 / (e1 + e2 + e3 + ev), 8) AS e1, round(e2 / (e1 + e2 + e3 + ev), 8) AS e2, round(e3 / (e1 + e2 + e3 + ev), 8) AS e3, round(ev / (e1 + e2 + e3 + ev), 8) AS ev FROM q",
    "cross_scale_resonance": f"WITH {MODWT}, q AS (SELECT symbol, ts, w1, w2, w3, avg(w1 * w1) OVER ({P}) AS a1, avg(w2 * w2) OVER ({P}) AS a2, avg(w3 * w3) OVER ({P}) AS a3 FROM v3 WHERE i >= 8) SELECT symbol, ts, round((a1 * sign(w1) + a2 * sign(w2) + a3 * sign(w3)) / nullif(a1 + a2 + a3, 0), 8) AS resonance FROM q",
    "conditional_lift": "WITH x AS (SELECT symbol, k, ret > 0 AS up, lead(ret) OVER (PARTITION BY symbol ORDER BY ts) AS fwd FROM rets), q AS (SELECT count(*) AS n, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) AS p0, count_if(up) AS nc, avg(CASE WHEN up THEN CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END END) AS p1 FROM x WHERE fwd IS NOT NULL AND up IS NOT NULL) SELECT n, nc AS n_cond, round(p0, 10) AS p_uncond, round(p1, 10) AS p_cond, round(p1 / nullif(p0, 0), 10) AS lift, round((p1 + 1.9207294103470494 / nc - 1.959963984540054 * sqrt(p1 * (1 - p1) / nc + 0.9603647051735247 / (nc * nc))) / (1 + 3.8414588206940988 / nc), 8) AS wilson_low, round((p1 + 1.9207294103470494 / nc + 1.959963984540054 * sqrt(p1 * (1 - p1) / nc + 0.9603647051735247 / (nc * nc))) / (1 + 3.8414588206940988 / nc), 8) AS wilson_high, nc < 30 AS power_warning, round((p1 - p0) / sqrt(p0 * (1 - p0) * (1.0 / nc + 1.0 / n)), 8) AS z FROM q",
    "drawdown_series": "SELECT symbol, ts, round(d, 10) AS drawdown FROM dd",
    "max_drawdown": "SELECT symbol, round(max(d), 10) AS max_drawdown FROM dd GROUP BY symbol",
    "drawdown_table": f"WITH {EPISODES} SELECT symbol, peak, trough, recovery, bars, round(depth, 10) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth DESC, peak) AS place FROM h WHERE under > 0) WHERE place <= 5",
    "ulcer_index": "SELECT symbol, round(sqrt(avg(d * d)), 10) AS ulcer FROM dd GROUP BY symbol",
    "time_under_water": f"WITH {EPISODES} SELECT symbol, max(under) AS longest FROM h GROUP BY symbol",
    "equity_from_returns": "SELECT symbol, ts, round(w, 10) AS equity FROM equity",
    "cagr": "SELECT symbol, round(exp(12.0 / count(*) * sum(ln(1 + r))) - 1, 10) AS cagr FROM small GROUP BY symbol HAVING count(*) >= 2",
    "calmar_ratio": "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM small) WHERE back <= 36), q AS (SELECT symbol, r, 1 - w / max(w) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM (SELECT symbol, ts, r, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY ts)) AS w FROM t)) SELECT symbol, round((exp(12.0 / count(*) * sum(ln(1 + r))) - 1) / nullif(max(d), 0), 8) AS calmar FROM q GROUP BY symbol HAVING count(*) = 36",
    "ratio_report": f"WITH {STATS} SELECT symbol, n, round(cagr, 8) AS cagr, round(m / nullif(sd, 0) * sqrt(12), 8) AS sharpe, round(m / nullif(down_full, 0) * sqrt(12), 8) AS sortino, round(m / nullif(down_only, 0) * sqrt(12), 8) AS sortino_downside, round(mdd, 8) AS max_drawdown, round(ulcer, 8) AS ulcer, round(cagr / nullif(ulcer, 0), 8) AS martin, round(cagr / nullif(amdd + 0.10, 0), 8) AS sterling FROM ra",
    "merton_fraction": "SELECT symbol, round((12 * avg(r) - 0.01) / (3 * nullif(12 * var_samp(r), 0)), 8) AS fraction FROM small GROUP BY symbol",
    "grossman_zhou_leverage": "SELECT symbol, ts, round(greatest(0.0, 2.0 * (1 - 0.8 / (1 - d)) / (1 - 0.8)), 8) AS leverage FROM dd WHERE d < 1",
    "kelly_with_drawdown_cap": "WITH q AS (SELECT symbol, avg(r) / nullif(var_samp(r), 0) AS kelly FROM small GROUP BY symbol) SELECT symbol, round(least(2 * kelly * (-ln(0.8)) / (-ln(0.8) + ln(1 / 0.1)), kelly), 8) AS leverage FROM q",
    "complexity_budget": "SELECT symbol, round(2 * 0.05 * count(*) / (3 * nullif(var_samp(r) * 4, 0)), 6) AS budget FROM small GROUP BY symbol",
    "expected_max_drawdown": "WITH q AS (SELECT symbol, avg(r) AS mu, stddev_samp(r) AS s, count(*) AS t FROM small GROUP BY symbol) SELECT symbol, round(1.2533141373155001 * s * sqrt(t), 8) AS driftless, round(CASE WHEN mu > 0 THEN s * s / (2 * mu) * ln(greatest(2 * mu * mu * t / (s * s), 1e-9)) WHEN mu < 0 THEN abs(mu) * t END, 6) AS asymptotic FROM q",
    "signed_momentum": f"SELECT symbol, ts, round(coalesce(ln(lag(close, 1) OVER ({P})) - ln(lag(close, 13) OVER ({P})), 0), 8) AS momentum FROM bars",
    "ewma_vol": f"WITH x AS (SELECT symbol, ts, count(lret) {over(-23)} AS c{''.join(f', lag(lret, {k}) OVER ({P}) AS l{k}' for k in range(24))} FROM rets), m AS (SELECT symbol, ts, ({' + '.join(f'{w!r} * l{k}' for k, w in EWMA)}) / {sum(w for _, w in EWMA)!r} AS mu, ({' + '.join(f'{w!r} * l{k} * l{k}' for k, w in EWMA)}) / {sum(w for _, w in EWMA)!r} AS m2 FROM x WHERE c = 24) SELECT symbol, ts, round(sqrt(greatest(m2 - mu * mu, 0) * 12), 8) AS vol FROM m",
    "direction_vol_target_gross_cap": f"WITH s AS (SELECT symbol, ts, sign(lag(close, 1) OVER ({P}) - lag(close, 7) OVER ({P})) AS dir, {full('stddev_samp(lret)', W, 'lret')} AS vol FROM rets), t AS (SELECT symbol, ts, dir * 0.1 / nullif(vol * sqrt(12), 0) / count(CASE WHEN vol > 0 AND dir IS NOT NULL THEN 1 END) OVER (PARTITION BY ts) AS w FROM s), g AS (SELECT symbol, ts, w, sum(abs(w)) OVER (PARTITION BY ts) AS gross FROM t) SELECT symbol, ts, round(w * least(1.0, 0.05 / nullif(gross, 0)), 8) AS weight FROM g",
    "contract_sizing": "SELECT symbol, ts, CAST($half_even(0.3 * 10000000 / nullif(close * 50, 0), 0) AS BIGINT) AS contracts FROM bars",
    "cubic_signal": f"WITH m AS (SELECT symbol, ts, (ln(close) - ln(lag(close, 6) OVER ({P}))) / nullif({full('stddev_samp(lret)', W, 'lret')} * sqrt(6), 0) AS z FROM rets) SELECT symbol, ts, round(greatest(-1.0, least(1.0, (z - z * z * z / 12.0) / 1.3333333333333333)), 8) AS signal FROM m",
    "threshold_carry": f"WITH s AS (SELECT symbol, ts, k, 100.0 * sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) {over(-W + 1)} / nullif(sum(abs(ret)) {over(-W + 1)}, 0) AS osc FROM rets), g AS (SELECT symbol, ts, osc, CASE WHEN osc < 40 THEN 1 WHEN osc > 60 THEN 0 END AS act FROM s) SELECT symbol, ts, coalesce(last_value(act IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM g",
    "regime_scale": f"SELECT symbol, ts, CASE WHEN v >= 0.9 THEN 1.0 WHEN v >= 0.5 THEN 0.5 ELSE 0.0 END AS scale FROM (SELECT symbol, ts, {full('stddev_samp(lret)', W, 'lret')} AS v FROM rets)",
    "rank_long_short": f"WITH m AS (SELECT symbol, ts, lag(close, 1) OVER ({P}) / nullif(lag(close, 12) OVER ({P}), 0) - 1 AS score FROM bars), r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS hi, row_number() OVER (PARTITION BY ts ORDER BY score, symbol DESC) AS lo FROM m WHERE score IS NOT NULL) SELECT symbol, ts, CASE WHEN hi <= 2 THEN 0.5 WHEN lo <= 2 THEN -0.5 ELSE 0.0 END AS weight FROM r",
    "decile_select": "WITH r AS (SELECT symbol, ts, ret, row_number() OVER (PARTITION BY ts ORDER BY ret, symbol) AS lo, row_number() OVER (PARTITION BY ts ORDER BY ret DESC, symbol DESC) AS hi, count(*) OVER (PARTITION BY ts) AS n FROM rets WHERE ret IS NOT NULL) SELECT symbol, ts, CASE WHEN hi <= greatest(1, $half_even(n * 0.3, 0)) THEN 'long' WHEN lo <= greatest(1, $half_even(n * 0.3, 0)) THEN 'short' ELSE 'flat' END AS leg FROM r",
    "ols_beta": f"WITH b AS (SELECT a.symbol, a.ts, a.ret, m.mkt FROM rets a JOIN (SELECT ts, avg(ret) AS mkt FROM rets GROUP BY ts) m ON a.ts = m.ts WHERE a.ret IS NOT NULL) SELECT symbol, ts, round(greatest(-2.0, least(2.0, CASE WHEN count(*) {over(-23)} >= 10 THEN covar_samp(ret, mkt) {over(-23)} / nullif(var_samp(mkt) {over(-23)}, 0) END)), 8) AS beta FROM b",
    "market_view": f"SELECT symbol, ts, round(close / lag(close, 3) OVER ({P}) - 1, 8) AS ret_3, round(close / lag(close, 12) OVER ({P}) - 1, 8) AS ret_12, round({full('stddev_samp(ret)', W, 'ret')}, 8) AS vol_12, round(1 - close / max(close) {over(-W + 1)}, 8) AS drawdown_12, round((volume - avg(volume) {over(-W + 1)}) / nullif(stddev_samp(volume) {over(-W + 1)}, 0), 8) AS volume_z FROM rets",
    "vector_simulate": f"WITH s AS (SELECT symbol, ts, k, ret, last_value(sign(lret) IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM rets), t AS (SELECT *, lag(w) OVER ({P}) AS held, abs(w - coalesce(lag(w) OVER ({P}), 0)) AS turn FROM s) SELECT symbol, ts, round(held * ret - 0.0005 * lag(turn) OVER ({P}), 8) AS pnl FROM t",
    "decision_dates": "SELECT symbol, CAST(date_trunc('quarter', ts) AS DATE) AS quarter, max(ts) AS decision FROM bars GROUP BY 1, 2",
    "other_momentum": f"WITH m AS (SELECT symbol, ts, ln(close) - ln(lag(close, 3) OVER ({P})) AS mom FROM bars) SELECT a.symbol, a.ts, round(a.mom, 8) AS mom, round(b.mom, 8) AS other_mom FROM m a JOIN m b ON a.ts = b.ts AND a.symbol = 'BUILDING' AND b.symbol = 'MACHINERY'",
    "eligibility": f"SELECT symbol, ts, coalesce(close >= 1000 AND {full('avg(volume)', 6, 'volume')} >= 100000, false) AS eligible FROM rets",
    "event_hold_age": f"WITH e AS (SELECT symbol, ts, k, max(CASE WHEN ret > 1 THEN k END) OVER ({P}) AS opened FROM rets) SELECT symbol, ts, k - opened AS age, coalesce(k - opened BETWEEN 1 AND 3, false) AS held FROM e",
}
