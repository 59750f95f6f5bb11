"""Price-volume factors of any frame: windows over the rows of one key in the order of a time column.

Each function takes a frame, the names of its columns and its parameters, and gives the frame with one more column.
Trailing windows end at the row itself; samples that must not hold the value they judge end at the row before. A window
with fewer values than its length gives null. Keys are partitions of the window, so that one shuffle by key (reused by
the functions that follow on the same key and order) is all that moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: Spread under which a sample counts as constant, in units of the size of its mean.
TOL = 1e-12


def frame(by: str, ts: str, lo: int | None, hi: int = 0) -> WindowSpec:
    return Window.partitionBy(by).orderBy(ts).rowsBetween(Window.unboundedPreceding if lo is None else lo, hi)


def full(value: Column, of: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate over w where the frame holds n values of `of`."""
    return F.when(F.count(of).over(w) == n, value.over(w))


def trailing(df: DataFrame, value: str, window: int, by: str = "symbol", ts: str = "ts", out: str = "trail") -> DataFrame:
    """The last `window` values, oldest first, with the row's own; null until there are as many rows, nulls kept."""
    w = frame(by, ts, 1 - window)
    held = F.transform(F.collect_list(F.struct(value)).over(w), lambda x: x[value])
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) == window, held))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is null, zero or not finite, or a is not finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(~bad(a) & ~bad(b) & (b != 0), a / b)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two arrays of one length; null if either is constant or holds a null. Kept within -1 and 1."""
    n = F.size(x)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e) / n
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    a, b = F.transform(x, lambda e: e - mean(x)), F.transform(y, lambda e: e - mean(y))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))))


def ranks(x: Column) -> Column:
    """Average ranks of an array's elements, from 1."""
    return F.transform(x, lambda e: F.size(F.filter(x, lambda o: o < e)) + (F.size(F.filter(x, lambda o: o == e)) + 1) / 2)


def excess_volume(df: DataFrame, window: int = 20, volume: str = "volume", by: str = "symbol", ts: str = "ts", out: str = "z") -> DataFrame:
    """Standard score of log(1 + volume) against the `window` rows before it."""
    past, x = frame(by, ts, -window, -1), F.log1p(volume)
    m, s, size = F.avg(x).over(past), F.stddev_samp(x).over(past), F.greatest(F.abs(F.avg(x).over(past)), F.lit(1.0))
    z = F.when(s > TOL * size, (x - m) / s).when(F.abs(x - m) <= TOL * size, 0.0)
    return df.withColumn(out, F.when(F.count(x).over(past) == window, z))


def volume_breakout(df: DataFrame, window: int = 20, threshold: float = 2.0, out: str = "breakout", **columns) -> DataFrame:
    """Whether the excess volume is over the threshold; no score is no breakout."""
    return excess_volume(df, window, out="_z", **columns).withColumn(out, F.coalesce(F.col("_z") > threshold, F.lit(False))).drop("_z")


def obv(df: DataFrame, close: str = "close", volume: str = "volume", by: str = "symbol", ts: str = "ts", out: str = "obv") -> DataFrame:
    """Running sum of volume signed by the change of close, 0 at the first row. A missing close or volume voids the rest."""
    order, upto = Window.partitionBy(by).orderBy(ts), frame(by, ts, None)
    first = F.row_number().over(order) == 1
    term = F.when(first & F.col(close).isNotNull(), 0.0 * F.col(volume)).otherwise(F.signum(F.col(close) - F.lag(close).over(order)) * F.col(volume))
    df = df.withColumn("_term", term)
    return df.withColumn(out, F.when(F.count(F.when(F.col("_term").isNull(), 1)).over(upto) == 0, F.sum("_term").over(upto))).drop("_term")


def _slope(df: DataFrame, value: str, window: int, by: str, ts: str) -> Column:
    w = frame(by, ts, 1 - window)
    return full(F.regr_slope(F.col(value), F.col("_k")), F.col(value), w, window)


def _placed(df: DataFrame, by: str, ts: str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(ts)))


def rolling_ols_slope(df: DataFrame, value: str, window: int = 20, by: str = "symbol", ts: str = "ts", out: str = "slope") -> DataFrame:
    return _placed(df, by, ts).withColumn(out, _slope(df, value, window, by, ts)).drop("_k")


def obv_slope(df: DataFrame, window: int = 20, volume: str = "volume", by: str = "symbol", ts: str = "ts", out: str = "obv_slope", **columns) -> DataFrame:
    """Slope of obv over the window in units of the window's mean volume."""
    df = rolling_ols_slope(obv(df, volume=volume, by=by, ts=ts, out="_o", **columns), "_o", window, by, ts, "_s")
    return df.withColumn(out, safe_ratio(F.col("_s"), F.avg(volume).over(frame(by, ts, 1 - window)))).drop("_o", "_s")


def price_volume_divergence(df: DataFrame, window: int = 20, method: str = "pearson", close: str = "close", by: str = "symbol", ts: str = "ts", out: str = "corr", **columns) -> DataFrame:
    """Correlation of close and obv over the window: of values ("pearson") or of their ranks ("spearman")."""
    df = obv(df, close=close, by=by, ts=ts, out="_o", **columns)
    w = frame(by, ts, 1 - window)
    if method == "pearson":
        cov, s = full(F.covar_pop(F.col(close), F.col("_o")), F.col("_o"), w, window), full(F.stddev_pop(close), F.col("_o"), w, window) * full(F.stddev_pop("_o"), F.col("_o"), w, window)
        return df.withColumn(out, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.nullif(s, F.lit(0.0))))).drop("_o")
    if method != "spearman":
        raise ValueError(f"unknown method {method}")
    df = trailing(trailing(df, close, window, by, ts, "_x"), "_o", window, by, ts, "_y")
    whole = ~F.exists("_x", lambda e: e.isNull()) & ~F.exists("_y", lambda e: e.isNull())
    return df.withColumn("_x", ranks(F.col("_x"))).withColumn("_y", ranks(F.col("_y"))).withColumn(out, F.when(whole, pearson(F.col("_x"), F.col("_y")))).drop("_o", "_x", "_y")


def divergence_flag(df: DataFrame, window: int = 20, close: str = "close", by: str = "symbol", ts: str = "ts", out: str = "flag", **columns) -> DataFrame:
    """-1 where price rises and 1 where it falls over the window while its correlation with obv is negative, else 0."""
    df = rolling_ols_slope(price_volume_divergence(df, window, close=close, by=by, ts=ts, out="_c", **columns), close, window, by, ts, "_s")
    against = F.col("_c") < 0
    return df.withColumn(out, F.when((F.col("_s") > 0) & against, -1).when((F.col("_s") < 0) & against, 1).otherwise(0)).drop("_c", "_s")


def typical_price(df: DataFrame, out: str = "typical_price") -> DataFrame:
    return df.withColumn(out, (F.col("high") + F.col("low") + F.col("close")) / 3)


def twap(df: DataFrame, out: str = "twap") -> DataFrame:
    return df.withColumn(out, (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)


def rolling_vwap(df: DataFrame, window: int = 20, volume: str = "volume", by: str = "symbol", ts: str = "ts", out: str = "vwap") -> DataFrame:
    """Typical price weighted by volume over the window; bars without a price or a volume count on neither side."""
    w = frame(by, ts, 1 - window)
    df = typical_price(df, "_tp").withColumn("_v", F.when(F.col("_tp").isNotNull(), F.col(volume)))
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) == window, F.sum(F.col("_tp") * F.col("_v")).over(w) / F.nullif(F.sum("_v").over(w), F.lit(0.0)))).drop("_tp", "_v")


def vwap_deviation(df: DataFrame, window: int = 20, close: str = "close", out: str = "deviation", **columns) -> DataFrame:
    df = rolling_vwap(df, window, out="_w", **columns)
    return df.withColumn(out, F.when(F.col("_w") > 0, F.col(close) / F.col("_w") - 1)).drop("_w")


def amihud_illiquidity(df: DataFrame, window: int = 20, ret: str = "ret", volume: str = "volume", by: str = "symbol", ts: str = "ts", scale: float = 1e9, out: str = "illiquidity") -> DataFrame:
    """Mean of |return| per volume over the window, rows without volume left out."""
    w, each = frame(by, ts, 1 - window), F.when(F.col(volume) > 0, F.abs(ret) / F.col(volume))
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) == window, scale * F.avg(each).over(w)))


def standardize(df: DataFrame, value: str, window: int | None = 60, method: str = "zscore", clip: float = 5.0, min_periods: int = 2, by: str = "symbol", ts: str = "ts", out: str = "z") -> DataFrame:
    """A value against the `window` rows before it (all rows before it if None): "zscore", "rank" or "robust".

    "rank": 2 * (share below + half the share equal) - 1. "robust": from the median, in 1.4826 median absolute
    deviations. There must be `min_periods` values before it.
    """
    past, x = frame(by, ts, None if window is None else -window, -1), F.col(value)
    n = F.count(x).over(past)
    enough = n >= min_periods
    if method == "zscore":
        m, s = F.avg(x).over(past), F.stddev_samp(x).over(past)
        z = F.when(s > TOL * F.greatest(F.abs(m), F.lit(1.0)), F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - m) / s))).when(F.abs(x - m) <= TOL, 0.0)
        return df.withColumn(out, F.when(enough, z))
    df = df.withColumn("_vs", F.when(enough & x.isNotNull(), F.collect_list(x).over(past)))
    vs = F.col("_vs")
    if method == "rank":
        share = (F.size(F.filter(vs, lambda e: e < F.col(value))) + 0.5 * F.size(F.filter(vs, lambda e: e == F.col(value)))) / F.size(vs)
        return df.withColumn(out, F.when(vs.isNotNull(), 2 * share - 1)).drop("_vs")
    if method != "robust":
        raise ValueError(f"unknown method {method}")
    middle = lambda a: (F.element_at(F.array_sort(a), F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(F.array_sort(a), F.floor(F.size(a) / 2 + 1).cast("int"))) / 2
    df = df.withColumn("_m", middle(vs)).withColumn("_d", F.transform("_vs", lambda e: F.abs(e - F.col("_m"))))
    return df.withColumn(out, (x - F.col("_m")) / F.nullif(1.4826 * middle(F.col("_d")), F.lit(0.0))).drop("_vs", "_m", "_d")


def detrend(df: DataFrame, value: str, method: str = "diff", lag: int = 1, window: int | None = 20, by: str = "symbol", ts: str = "ts", out: str = "detrended") -> DataFrame:
    """The change over `lag` rows ("diff", "logdiff") or the residual of a line through the window ("ols"; all rows so far
    if the window is None)."""
    order = Window.partitionBy(by).orderBy(ts)
    if method == "diff":
        return df.withColumn(out, F.col(value) - F.lag(value, lag).over(order))
    if method == "logdiff":
        return df.withColumn(out, F.log(value) - F.log(F.lag(value, lag).over(order)))
    if method != "ols":
        raise ValueError(f"unknown method {method}")
    df, w = _placed(df, by, ts), frame(by, ts, None if window is None else 1 - window)
    line = F.regr_intercept(F.col(value), F.col("_k")).over(w) + F.regr_slope(F.col(value), F.col("_k")).over(w) * F.col("_k")
    n = F.count(value).over(w)
    return df.withColumn(out, F.when(n >= 3 if window is None else n == window, F.col(value) - line)).drop("_k")
