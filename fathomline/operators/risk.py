"""Drawdown and risk of equity curves and returns, by key: windows in time order and aggregates by key.

Frames hold a key, a time and a return (`ret`) or a wealth (`wealth`); the columns' names are parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def _order(by: str, ts: str):
    return Window.partitionBy(by).orderBy(ts)


def equity(df: DataFrame, ret: str = "r", by: str = "symbol", ts: str = "ts", out: str = "w") -> DataFrame:
    """Growth of one unit."""
    return df.withColumn(out, F.exp(F.sum(F.log1p(ret)).over(_order(by, ts))))


def drawdown_series(df: DataFrame, wealth: str = "w", by: str = "symbol", ts: str = "ts", out: str = "drawdown") -> DataFrame:
    """Loss from the highest wealth so far, as a positive share of it."""
    return df.withColumn(out, 1 - F.col(wealth) / F.max(wealth).over(_order(by, ts)))


def max_drawdown(df: DataFrame, by: str = "symbol", **columns) -> DataFrame:
    return drawdown_series(df, by=by, out="_d", **columns).groupBy(by).agg(F.max("_d").alias("max_drawdown"))


def ulcer_index(df: DataFrame, by: str = "symbol", **columns) -> DataFrame:
    """Root mean square of drawdowns."""
    return drawdown_series(df, by=by, out="_d", **columns).groupBy(by).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("ulcer"))


def _episodes(df: DataFrame, wealth: str, by: str, ts: str) -> DataFrame:
    """A row for each run of rows from one peak to the row before the next."""
    df = drawdown_series(df, wealth, by, ts, "_d")
    df = df.withColumn("_e", F.sum(F.when(F.col("_d") <= 0, 1).otherwise(0)).over(_order(by, ts)))
    at = F.struct((-F.col("_d")).alias("d"), F.col(ts).alias("t"))
    runs = df.groupBy(by, "_e").agg(F.min(ts).alias("peak"), F.count("*").alias("bars"), F.max("_d").alias("depth"), F.min(at)["t"].alias("trough"), F.count_if(F.col("_d") > 0).alias("under"))
    return runs.withColumn("recovery", F.lead("peak").over(_order(by, "_e")))


def drawdown_table(df: DataFrame, top: int = 5, wealth: str = "w", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """The `top` deepest drawdowns of each key: peak, trough, recovery (null if none), bars, depth; earlier ones first at ties."""
    runs = _episodes(df, wealth, by, ts).where("under > 0")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("depth"), "peak"))
    return runs.withColumn("_p", place).where(F.col("_p") <= top).select(by, "peak", "trough", "recovery", "bars", "depth")


def time_under_water(df: DataFrame, wealth: str = "w", by: str = "symbol", ts: str = "ts") -> DataFrame:
    return _episodes(df, wealth, by, ts).groupBy(by).agg(F.max("under").alias("longest"))


def cagr(df: DataFrame, ret: str = "r", by: str = "symbol", periods: float = 252) -> DataFrame:
    """Compound growth a year; keys with fewer than two returns are left out."""
    return df.groupBy(by).agg(F.count(ret).alias("_n"), F.sum(F.log1p(ret)).alias("_s")).where("_n >= 2").select(by, (F.exp(periods / F.col("_n") * F.col("_s")) - 1).alias("cagr"))


def calmar_ratio(df: DataFrame, window: int = 36, ret: str = "r", by: str = "symbol", ts: str = "ts", periods: float = 12) -> DataFrame:
    """Growth a year over the greatest drawdown, of the last `window` rows; keys with fewer are left out."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts)))
    last = equity(df.withColumn("_b", back).where(F.col("_b") <= window), ret, by, ts, "_w")
    last = drawdown_series(last, "_w", by, ts, "_d")
    got = last.groupBy(by).agg(F.count("*").alias("_n"), F.sum(F.log1p(ret)).alias("_s"), F.max("_d").alias("_m")).where(F.col("_n") == window)
    return got.select(by, ((F.exp(periods / F.col("_n") * F.col("_s")) - 1) / F.nullif("_m", F.lit(0.0))).alias("calmar"))


def annual_drawdowns(df: DataFrame, ret: str = "r", by: str = "symbol", ts: str = "ts", least: int = 2) -> DataFrame:
    """Greatest drawdown of each calendar year with at least `least` rows, of wealth that starts anew each year."""
    y = df.withColumn("year", F.year(ts))
    w = Window.partitionBy(by, "year").orderBy(ts)
    y = y.withColumn("_w", F.exp(F.sum(F.log1p(ret)).over(w)))
    y = y.withColumn("_d", 1 - F.col("_w") / F.max("_w").over(w))
    return y.groupBy(by, "year").agg(F.max("_d").alias("max_drawdown"), F.count("*").alias("n")).where(F.col("n") >= least)


def ratio_report(df: DataFrame, ret: str = "r", by: str = "symbol", ts: str = "ts", periods: float = 252, excess: float = 0.10, window: int = 36, avg_n: int = 3) -> DataFrame:
    """A row for each key: n, total_return, cagr, vol, sharpe, sortino (all rows below 0 over n), sortino_downside (over
    the rows below 0), max_drawdown, ulcer, martin, calmar, sterling (mean annual drawdown plus `excess`),
    sterling_avg_n (mean of the avg_n greatest annual drawdowns instead), longest (rows under water)."""
    r = F.col(ret)
    grown = equity(df, ret, by, ts, "_w")
    base = grown.groupBy(by).agg(
        F.count(ret).alias("n"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_sd"), (F.exp(F.sum(F.log1p(ret))) - 1).alias("total_return"),
        F.sqrt(F.sum(F.when(r < 0, r * r).otherwise(0.0)) / F.count(ret)).alias("_df"), F.sqrt(F.sum(F.when(r < 0, r * r)) / F.nullif(F.count_if(r < 0), F.lit(0))).alias("_do"),
    )
    drawn = drawdown_series(grown, "_w", by, ts, "_d").groupBy(by).agg(F.max("_d").alias("max_drawdown"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("ulcer"))
    year = annual_drawdowns(df, ret, by, ts).withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("max_drawdown"), "year")))
    year = year.groupBy(by).agg(F.avg("max_drawdown").alias("_a"), F.avg(F.when(F.col("_p") <= avg_n, F.col("max_drawdown"))).alias("_an"))
    out = base.join(drawn, by).join(year, by, "left").join(calmar_ratio(df, window, ret, by, ts, periods), by, "left").join(time_under_water(grown, "_w", by, ts), by, "left")
    g, none, root = F.pow(1 + F.col("total_return"), periods / F.col("n")) - 1, F.lit(0.0), math.sqrt(periods)
    ratio = lambda a, b: a / F.nullif(b, none)
    return out.select(
        by, "n", "total_return", g.alias("cagr"), (F.col("_sd") * root).alias("vol"), (ratio(F.col("_m"), F.col("_sd")) * root).alias("sharpe"), (ratio(F.col("_m"), F.col("_df")) * root).alias("sortino"),
        (ratio(F.col("_m"), F.col("_do")) * root).alias("sortino_downside"), "max_drawdown", "ulcer", ratio(g, F.col("ulcer")).alias("martin"), "calmar",
        ratio(g, F.col("_a") + excess).alias("sterling"), ratio(g, F.col("_an")).alias("sterling_avg_n"), "longest",
    )


def merton_fraction(mu: Column, sigma: Column, risk_aversion: float, rate: float = 0.0) -> Column:
    return (mu - rate) / (risk_aversion * F.nullif(sigma * sigma, F.lit(0.0)))


def grossman_zhou_leverage(drawdown: Column, floor: float, merton: float) -> Column:
    """Leverage that keeps wealth over `floor` times its peak: none at the floor, `merton` at the peak."""
    return F.greatest(F.lit(0.0), merton * (1 - floor / F.nullif(1 - drawdown, F.lit(0.0))) / (1 - floor))


def kelly_with_drawdown_cap(mu: Column, variance: Column, limit: float, chance: float) -> Column:
    """Kelly leverage, lowered so that a drawdown of `limit` has at most `chance`."""
    kelly, room = mu / F.nullif(variance, F.lit(0.0)), -math.log(1 - limit)
    return F.least(2 * kelly * room / (room + math.log(1 / chance)), kelly)


#: Points at which the expected drawdown without drift is tabulated by rule: see expected_max_drawdown.
TERMS = 400


def expected_max_drawdown(mu: float, sigma: float, t: float, method: str = "auto") -> float:
    """Expected greatest drawdown of a Brownian motion with drift over the time t.

    "asymptotic": sqrt(pi / 2) * sigma * sqrt(t) without drift; with drift up, the leading term with its constant; with
    drift down, |mu| * t + sigma^2 / |mu|. "exact": the mean of the chance, by its eigenfunction series, that the
    drawdown has passed h, over h. "auto": exact for |mu| * sqrt(t) / sigma up to 5, else asymptotic.
    """
    if sigma <= 0 or t <= 0:
        raise ValueError("sigma and t must be positive")
    if method == "auto":
        method = "exact" if abs(mu) * math.sqrt(t) / sigma <= 5 else "asymptotic"
    if method == "asymptotic":
        if mu == 0:
            return math.sqrt(math.pi / 2) * sigma * math.sqrt(t)
        if mu > 0:
            return 2 * sigma * sigma / mu * (0.25 * math.log(t) + 0.5 * math.log(mu / sigma) + 0.49088)
        return abs(mu) * t + sigma * sigma / abs(mu)
    if method != "exact":
        raise ValueError(f"unknown method {method}")
    # scaled so that sigma = t = 1: the drawdown is a reflected motion with drift -m; absorb it at h on a grid of h
    m = mu * math.sqrt(t) / sigma
    top, steps = 6.0 + 1.5 * max(-m, 0.0), 240
    step = top / steps
    total = 0.0
    for i in range(steps):
        total += step * _passed((i + 0.5) * step, m)
    return total * sigma * math.sqrt(t)


def _passed(h: float, m: float) -> float:
    """Chance that a unit motion reflected at 0, with drift -m, reaches h within one unit of time (implicit steps)."""
    n, steps = 60, 120
    dx, dt = h / n, 1.0 / steps
    a, b = 0.5 / dx**2, -m / (2 * dx)  # u(x, t): chance still below h; u_t = u_xx / 2 - m u_x, u_x(0) = 0, u(h) = 0
    lower, upper, diag = -(a - b) * dt, -(a + b) * dt, 1 + 2 * a * dt
    u = [1.0] * n
    for _ in range(steps):
        c, d = [0.0] * n, [0.0] * n
        c[0], d[0] = (lower + upper) / diag, u[0] / diag
        for i in range(1, n):
            k = diag - lower * c[i - 1]
            c[i] = upper / k
            d[i] = (u[i] - lower * d[i - 1]) / k
        u[n - 1] = d[n - 1]
        for i in range(n - 2, -1, -1):
            u[i] = d[i] - c[i] * u[i + 1]
    return 1 - u[0]


def mdd_scaling_check(df: DataFrame, horizons: tuple[int, ...] = (12, 24, 48), ret: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Mean greatest drawdown of consecutive blocks of each horizon: key, horizon, blocks, mean_mdd, per_root (mean_mdd over
    the root of the horizon, level for returns without drift)."""
    placed = df.withColumn("_k", F.row_number().over(_order(by, ts)) - 1).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    placed = placed.withColumn("_b", F.floor(F.col("_k") / F.col("horizon")))
    w = Window.partitionBy(by, "horizon", "_b").orderBy("_k")
    placed = placed.withColumn("_w", F.exp(F.sum(F.log1p(ret)).over(w))).withColumn("_d", 1 - F.col("_w") / F.greatest(F.lit(1.0), F.max("_w").over(w)))
    block = placed.groupBy(by, "horizon", "_b").agg(F.max("_d").alias("_m"), F.count("*").alias("_n")).where(F.col("_n") == F.col("horizon"))
    return block.groupBy(by, "horizon").agg(F.count("*").alias("blocks"), F.avg("_m").alias("mean_mdd")).withColumn("per_root", F.col("mean_mdd") / F.sqrt("horizon"))
