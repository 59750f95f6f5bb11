"""Validation statistics of return series by key: moments, autocorrelation, Sharpe statistics, splits and resampling.

Aggregates and windows by key wherever they can say it; resampling draws from a seeded generator over one key's whole
series, which goes to one task.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tails

EULER = 0.5772156649015329


def moments(df: DataFrame, ret: str = "r", by: str = "symbol") -> DataFrame:
    """n, mean, sd (of a sample), sr (mean over sd), skew, kurt (a normal's is 3)."""
    return df.groupBy(by).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"), F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurt")).withColumn("sr", F.col("mean") / F.nullif("sd", F.lit(0.0)))


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Chance that the true Sharpe ratio (a period) is over the benchmark."""
    return tails.normal_cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))


def expected_max_sharpe(variance: Column, trials: Column) -> Column:
    """Expected greatest Sharpe ratio of so many trials without skill; 0 for one."""
    q = tails.normal_quantile
    return F.when(trials <= 1, 0.0).otherwise(F.sqrt(variance) * ((1 - EULER) * q(1 - 1 / trials) + EULER * q(1 - 1 / (trials * math.e))))


def deflated_sharpe(df: DataFrame, trials: int, ret: str = "r", by: str = "symbol") -> DataFrame:
    """A row for each key: sr, psr (against 0), benchmark (greatest of `trials` by chance, from the spread of the keys'
    ratios, 1 / (n - 1) at least) and dsr (against it)."""
    m = moments(df, ret, by)
    spread = m.agg(F.greatest(1.0 / (F.max("n") - 1), F.coalesce(F.var_samp("sr"), F.lit(0.0))).alias("_v"))
    m = m.crossJoin(F.broadcast(spread)).withColumn("benchmark", expected_max_sharpe(F.col("_v"), F.lit(float(trials))))
    of = lambda b: probabilistic_sharpe(F.col("sr"), b, F.col("n"), F.col("skew"), F.col("kurt"))
    return m.select(by, "n", "sr", of(F.lit(0.0)).alias("psr"), "benchmark", of(F.col("benchmark")).alias("dsr"))


def autocorrelation(df: DataFrame, lags: int, value: str = "r", by: str = "symbol", ts: str = "ts", absolute: bool = False) -> DataFrame:
    """by, n, g0 and rho (an array, lags 1 and up) of values less their mean, or of the size of that."""
    x = F.col(value) - F.avg(value).over(Window.partitionBy(by))
    df = df.where(F.col(value).isNotNull()).withColumn("_x", F.abs(x) if absolute else x)
    if absolute:
        df = df.withColumn("_x", F.col("_x") - F.avg("_x").over(Window.partitionBy(by)))
    order = Window.partitionBy(by).orderBy(ts)
    df = df.withColumns({f"_l{k}": F.lag("_x", k).over(order) for k in range(1, lags + 1)})
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("g0"), *[F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_g{k}") for k in range(1, lags + 1)])
    return g.select(by, "n", "g0", F.array(*[F.col(f"_g{k}") / F.nullif("g0", F.lit(0.0)) for k in range(1, lags + 1)]).alias("rho"))


def ljung_box(df: DataFrame, lags: tuple[int, ...] = (5, 10, 20), absolute: bool = False, **columns) -> DataFrame:
    """by, lags, q and its chance: a row for each number of lags."""
    by = columns.get("by", "symbol")
    acf = autocorrelation(df, max(lags), absolute=absolute, **columns).withColumn("lags", F.explode(F.array(*map(F.lit, lags))))
    terms = F.transform(F.slice("rho", F.lit(1), F.col("lags")), lambda r, i: r * r / (F.col("n") - i - 1))
    q = F.col("n") * (F.col("n") + 2) * F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return acf.withColumn("q", q).select(by, "lags", "q", tails.chi2_tail(F.col("q"), F.col("lags")).alias("p"))


def t_test(df: DataFrame, ret: str = "r", by: str = "symbol") -> DataFrame:
    t = F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return moments(df, ret, by).withColumn("t", t).select(by, "n", "t", tails.t_two_sided(F.col("t"), F.col("n") - 1).alias("p"))


def adjusted(df: DataFrame, p: str = "p") -> DataFrame:
    """bonferroni and holm of all rows' chances. A row a test: the few of a study, in one window."""
    order = Window.orderBy(p)
    ranked = df.withColumns({"_k": F.row_number().over(order), "_m": F.count("*").over(Window.partitionBy())})
    step = F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_k") + 1))
    return ranked.withColumns({"bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("_m")), "holm": F.max(step).over(Window.orderBy("_k"))}).drop("_k", "_m")


def folds(df: DataFrame, k: int, row: str = "k") -> DataFrame:
    """Rows dealt to k contiguous folds of nearly equal size, the first ones larger. row: 0 and up without gaps."""
    n = df.agg((F.max(row) + 1).alias("_n"))
    big, size = F.col("_n") % k, F.floor(F.col("_n") / k)
    edge = big * (size + 1)
    fold = F.when(F.col(row) < edge, F.floor(F.col(row) / (size + 1))).otherwise(big + F.floor((F.col(row) - edge) / F.greatest(size, F.lit(1))))
    return df.crossJoin(F.broadcast(n)).withColumn("fold", fold.cast("int")).drop("_n")


def cpcv(df: DataFrame, groups: int = 6, test: int = 2, embargo: int = 0, row: str = "k") -> DataFrame:
    """Every way to hold out `test` of the contiguous groups: split, row, role ("train" or "test"). Training rows within
    `embargo` rows of a held-out group are left out. There are C(groups, test) rows out for each row in."""
    held = [list(c) for c in itertools.combinations(range(groups), test)]
    spark = df.sparkSession
    splits = spark.createDataFrame([(i, c) for i, c in enumerate(held)], "split int, held array<int>")
    at = folds(df.select(row), groups, row)
    edges = at.groupBy("fold").agg(F.min(row).alias("lo"), F.max(row).alias("hi")).agg(F.collect_list(F.struct("fold", "lo", "hi")).alias("edges"))
    out = at.crossJoin(F.broadcast(splits)).crossJoin(F.broadcast(edges))
    near = F.exists("edges", lambda e: F.array_contains("held", e["fold"]) & (F.col(row) >= e["lo"] - embargo) & (F.col(row) <= e["hi"] + embargo))
    out = out.withColumn("role", F.when(F.array_contains("held", F.col("fold")), "test").when(~near, "train"))
    return out.where("role is not null").select("split", row, "fold", "role")


def pbo(df: DataFrame, blocks: int = 10, ret: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Chance of backtest overfitting: over all ways to take half of the blocks, how often the model with the best Sharpe
    ratio inside ranks in the lower half outside. One row: splits, pbo. Only sums by block and model are combined."""
    b = df.withColumn("_b", F.ntile(blocks).over(Window.partitionBy(by).orderBy(ts)) - 1)
    sums = b.groupBy(by, "_b").agg(F.count(ret).alias("n"), F.sum(ret).alias("s"), F.sum(F.col(ret) * F.col(ret)).alias("q"))
    ways = [sum(1 << g for g in c) for c in itertools.combinations(range(blocks), blocks // 2)]
    split = df.sparkSession.createDataFrame([(w,) for w in ways], "split long")
    each = sums.crossJoin(F.broadcast(split)).withColumn("in", F.expr("getbit(split, _b) = 1"))

    def sharpe(cond):
        n, s, q = (F.sum(F.when(cond, F.col(c)).otherwise(0)) for c in ("n", "s", "q"))
        return (s / n) / F.nullif(F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))), F.lit(0.0))

    got = each.groupBy("split", by).agg(sharpe(F.col("in")).alias("ins"), sharpe(~F.col("in")).alias("oos"))
    w = Window.partitionBy("split")
    got = got.withColumns({"best": F.row_number().over(w.orderBy(F.desc_nulls_last("ins"), by)), "m": F.count("*").over(w), "le": F.count("oos").over(w.orderBy("oos").rangeBetween(Window.unboundedPreceding, 0))})
    share = F.col("le") / (F.col("m") + 1)
    return got.where("best = 1").agg(F.count("*").alias("splits"), F.avg(F.when(F.log(share / (1 - share)) <= 0, 1.0).otherwise(0.0)).alias("pbo"))


def _sharpe(x: np.ndarray, axis: int = -1) -> np.ndarray:
    s = x.std(axis, ddof=1)
    return np.where(s > 0, x.mean(axis) / np.where(s > 0, s, 1), 0.0)


def bootstrap_sharpe(df: DataFrame, draws: int = 2000, block: int = 20, periods: float = 252, seed: int = 7, level: float = 0.95, ret: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Sharpe ratio a year with the interval of resampled ones, and the chance of a mean as far from 0 in resamples of the
    series less its mean. Blocks are circular and of fixed length (1: single returns)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(ts, kind="stable")[ret].dropna().to_numpy(float)
        n = len(x)
        if n < 2:
            return pd.DataFrame([{by: str(pdf[by].iloc[0]), "n": n}], columns=[by, "n", "sharpe", "low", "high", "p"])
        rng = np.random.default_rng(seed)
        start = rng.integers(0, n, (draws, -(-n // block)))
        at = ((start[:, :, None] + np.arange(block)) % n).reshape(draws, -1)[:, :n]
        root = math.sqrt(periods)
        lo, hi = np.quantile(_sharpe(x[at]) * root, [(1 - level) / 2, (1 + level) / 2])
        p = float((np.abs((x - x.mean())[at].mean(1)) >= abs(x.mean())).mean())
        return pd.DataFrame([{by: str(pdf[by].iloc[0]), "n": n, "sharpe": float(_sharpe(x)) * root, "low": lo, "high": hi, "p": p}])

    return df.select(by, ts, ret).groupBy(by).applyInPandas(run, f"{by} string, n long, sharpe double, low double, high double, p double")


def sign_flip(df: DataFrame, draws: int = 2000, seed: int = 7, ret: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Chance of a Sharpe ratio as great (one-sided) or as far from 0 (two-sided) when the returns' signs are drawn."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(ts, kind="stable")[ret].dropna().to_numpy(float)
        null = _sharpe(x * np.random.default_rng(seed).choice([-1.0, 1.0], (draws, len(x))))
        s = float(_sharpe(x))
        return pd.DataFrame([{by: str(pdf[by].iloc[0]), "sharpe": s, "p_one": float((null >= s).mean()), "p_two": float((np.abs(null) >= abs(s)).mean())}])

    return df.select(by, ts, ret).groupBy(by).applyInPandas(run, f"{by} string, sharpe double, p_one double, p_two double")


#: Days between rows to periods a year: the nearest by ratio is taken.
CALENDARS = (252.0, 52.0, 12.0, 4.0, 1.0)


def validation_report(df: DataFrame, trials: int = 1, ret: str = "r", by: str = "symbol", ts: str = "ts", least: int = 20) -> DataFrame:
    """A row for each key: n, periods (from the median gap), cagr, sharpe, max_drawdown (negative), psr, dsr. Returns that
    are null or not finite are left out; a key with under `least` gets null figures."""
    from . import risk

    df = df.where(F.col(ret).isNotNull() & ~F.isnan(ret) & (F.abs(ret) != float("inf")))
    gap = df.withColumn("_g", F.datediff(ts, F.lag(ts).over(Window.partitionBy(by).orderBy(ts)))).groupBy(by).agg(F.percentile("_g", F.lit(0.5)).alias("_g"))
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.log(365.25 / F.greatest("_g", F.lit(1.0)) / c)).alias("d"), F.lit(c).alias("c")) for c in CALENDARS]))["c"]
    grown = risk.equity(df, ret, by, ts, "_w")
    drawn = risk.max_drawdown(grown, by=by, wealth="_w", ts=ts)
    total = df.groupBy(by).agg(F.sum(F.log1p(ret)).alias("_s"))
    m = deflated_sharpe(df, trials, ret, by).join(gap, by).join(drawn, by).join(total, by).withColumn("periods", nearest)
    ok = lambda c: F.when(F.col("n") >= least, c)
    return m.select(by, "n", "periods", ok(F.exp(F.col("periods") / F.col("n") * F.col("_s")) - 1).alias("cagr"), ok(F.col("sr") * F.sqrt("periods")).alias("sharpe"), ok(-F.col("max_drawdown")).alias("max_drawdown"), ok(F.col("psr")).alias("psr"), ok(F.col("dsr")).alias("dsr"))


def facts(df: DataFrame, ret: str = "r", by: str = "symbol", ts: str = "ts", lags: int = 21) -> DataFrame:
    """n, jb_p (normality), lb_p (no autocorrelation), n_eff, for keys with 20 returns that vary."""
    acf = autocorrelation(df, lags, ret, by, ts)
    used = F.greatest(F.least(F.greatest(F.lit(lags), F.floor(10 * F.log10("n"))), F.floor(F.col("n") / 5), F.lit(lags)), F.lit(1)).cast("int")
    rho = F.slice("rho", F.lit(1), used)
    positive = F.aggregate(F.filter(rho, lambda r: r > 0), F.lit(0.0), lambda a, b: a + b)
    q = F.col("n") * (F.col("n") + 2) * F.aggregate(F.transform(rho, lambda r, i: r * r / (F.col("n") - i - 1)), F.lit(0.0), lambda a, b: a + b)
    got = acf.withColumns({"n_eff": F.floor(F.col("n") / F.greatest(F.lit(1.0), 1 + 2 * positive)), "lags": used, "_q": q}).drop("n")
    m = moments(df, ret, by).where("n >= 20 and sd > 0").join(got, by)
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.pow(F.col("kurt") - 3, 2) / 4)
    return m.select(by, "n", "lags", F.exp(-jb / 2).alias("jb_p"), tails.chi2_tail(F.col("_q"), F.col("lags")).alias("lb_p"), "n_eff")


def resolved(facts: DataFrame, rules: list[dict]) -> DataFrame:
    """Facts (key, name, value) decided by rules {slot, name, low, high, verdict}: low <= value < high, null is open. Each
    slot of a key must meet exactly one rule; none or several raise an error. key, slot, verdict, rule_id."""
    import hashlib
    import json

    schema = "slot string, name string, low double, high double, verdict string, rule_id string"
    rows = [(r["slot"], r["name"], r.get("low"), r.get("high"), r["verdict"], hashlib.sha256(json.dumps(r, sort_keys=True).encode()).hexdigest()[:10]) for r in rules]
    table = facts.sparkSession.createDataFrame(rows, schema)
    meets = (facts["name"] == table["name"]) & F.coalesce(F.col("value") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("value") < F.col("high"), F.lit(True))
    slots = facts.select("key").distinct().crossJoin(F.broadcast(table.select("slot").distinct()))
    got = facts.join(F.broadcast(table), meets).groupBy("key", "slot").agg(F.count("*").alias("_n"), F.min("verdict").alias("verdict"), F.min("rule_id").alias("rule_id"))
    out = slots.join(got, ["key", "slot"], "left")
    wrong = F.raise_error(F.concat_ws(" ", F.col("key"), F.col("slot"), F.lit("meets"), F.coalesce("_n", F.lit(0)).cast("string"), F.lit("rules")))
    return out.select("key", "slot", F.when(F.coalesce("_n", F.lit(0)) != 1, wrong).otherwise(F.col("verdict")).alias("verdict"), "rule_id")


def first_of_class(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Triage of candidates: the first row of each class is its representative, the others name it."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumns({"duplicate": F.row_number().over(w) > 1, "representative": F.first(order).over(w)})


def variance_ratio(df: DataFrame, qs: tuple[int, ...] = (2, 4, 8, 16), value: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """by, q, vr (1 for a random walk), z and p, and z_het and p_het that allow for changing variance: a row for each q.
    Keys with under 2 q values have none for that q. Lagged products come from one window, not from joins."""
    part = Window.partitionBy(by)
    order = part.orderBy(ts)
    top = max(qs)
    df = df.where(F.col(value).isNotNull()).withColumns({"_c": F.col(value) - F.avg(value).over(part), "_i": F.row_number().over(order)})
    df = df.withColumns({f"_l{k}": F.lag("_c", k).over(order) for k in range(1, top)} | {f"_b{q}": F.when(F.col("_i") >= q, F.sum("_c").over(order.rowsBetween(1 - q, 0))) for q in qs})
    sq = lambda c: F.col(c) * F.col(c)
    s = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(sq("_c")).alias("g"), *[F.sum(sq("_c") * sq(f"_l{k}")).alias(f"_h{k}") for k in range(1, top)], *[F.sum(sq(f"_b{q}")).alias(f"_e{q}") for q in qs])
    rows = []
    for q in qs:
        vr = F.col(f"_e{q}") / (q * (F.col("n") - q + 1) * (1 - q / F.col("n"))) / (F.col("g") / (F.col("n") - 1))
        theta = sum(((2 * (q - k) / q) ** 2 * F.col(f"_h{k}") for k in range(1, q)), F.lit(0.0)) / (F.col("g") * F.col("g"))
        rows.append(F.when(F.col("n") >= 2 * q, F.struct(F.lit(q).alias("q"), vr.alias("vr"), ((vr - 1) / F.sqrt(2 * (2 * q - 1) * (q - 1) / (3 * q * F.col("n")))).alias("z"), ((vr - 1) / F.sqrt(F.nullif(theta, F.lit(0.0)))).alias("z_het"))))
    out = s.select(by, F.explode(F.array_compact(F.array(*rows))).alias("x")).select(by, "x.*")
    return out.withColumns({"p": tails.normal_two_sided(F.col("z")), "p_het": tails.normal_two_sided(F.col("z_het"))})


def runs_test(df: DataFrame, value: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """by, runs, z and p of runs of one sign; zeros are left out."""
    s = df.where(F.col(value) != 0).withColumn("_s", F.signum(value))
    s = s.withColumn("_p", F.lag("_s").over(Window.partitionBy(by).orderBy(ts)))
    g = s.groupBy(by).agg((1 + F.count_if(F.col("_s") != F.col("_p"))).alias("runs"), F.count_if(F.col("_s") > 0).cast("double").alias("a"), F.count_if(F.col("_s") < 0).cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    z = (F.col("runs") - (2 * a * b / n + 1)) / F.nullif(F.sqrt(2 * a * b * (2 * a * b - n) / (n * n * (n - 1))), F.lit(0.0))
    return g.withColumn("z", z).select(by, "runs", "z", tails.normal_two_sided(F.col("z")).alias("p"))


def permutation_entropy(df: DataFrame, m: int = 3, value: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """by, entropy of the orders of m values in a row (earlier ones first at ties), 1 if all orders are as frequent."""
    order = Window.partitionBy(by).orderBy(ts)
    df = df.where(F.col(value).isNotNull()).withColumn("_v", F.collect_list(value).over(order.rowsBetween(1 - m, 0))).where(F.size("_v") == m)
    code = F.concat_ws(",", F.transform(F.array_sort(F.transform("_v", lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda x: x["i"].cast("string")))
    n = df.groupBy(by, code.alias("_o")).agg(F.count("*").alias("_n")).withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(by)))
    return n.groupBy(by).agg((0.0 - F.sum(F.col("_p") * F.log("_p")) / math.log(math.factorial(m))).alias("entropy"))


#: Weights of the suitability score, and where its parts begin and are full.
WEIGHTS = {"variance_ratio": 35.0, "ljung_box": 25.0, "runs": 15.0, "entropy": 15.0, "hurst": 10.0}
ENTROPY_FROM, ENTROPY_SPAN, HURST_SPAN, SUITABLE, MARGINAL = 0.99, 0.10, 0.15, 55.0, 25.0


def suitability(df: DataFrame, alpha: float = 0.05, value: str = "r", by: str = "symbol", ts: str = "ts", qs: tuple[int, ...] = (2, 4, 8, 16), lags: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """How far a series can be told from a random walk: the parts' scores, score (0 to 100) and verdict.

    The share of q whose variance ratio rejects (allowing for changing variance), Ljung-Box at any of the lags, runs,
    entropy of orders of four below 0.99, and the distance of the exponent of detrended fluctuation from a half.
    """
    from . import kernels

    def exponent(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values(ts, kind="stable")[value].dropna().to_numpy(float)
        h = kernels.dfa(x) if len(x) >= 16 else math.nan
        return pd.DataFrame([(p[by].iloc[0], len(x), None if math.isnan(h) else h)], columns=[by, "n", "dfa"])

    kind = df.schema[by].dataType.simpleString()
    h = df.select(by, ts, value).groupBy(by).applyInPandas(exponent, f"{by} {kind}, n long, dfa double")
    vr = variance_ratio(df, qs, value, by, ts).groupBy(by).agg(F.avg((F.col("p_het") < alpha).cast("double")).alias("_vr"))
    lb = ljung_box(df, lags, value=value, by=by, ts=ts).groupBy(by).agg(F.min("p").alias("_lb"))
    rt = runs_test(df, value, by, ts).select(by, F.col("p").alias("_rt"))
    pe = permutation_entropy(df, 4, value, by, ts)
    all_ = h.join(vr, by, "left").join(lb, by, "left").join(rt, by, "left").join(pe, by, "left")
    unit = lambda c: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), F.lit(0.0))
    parts = {
        "variance_ratio": unit(F.col("_vr")), "ljung_box": unit((F.col("_lb") < alpha).cast("double")), "runs": unit((F.col("_rt") < alpha).cast("double")),
        "entropy": unit((ENTROPY_FROM - F.col("entropy")) / ENTROPY_SPAN), "hurst": unit(F.abs(F.col("dfa") - 0.5) / HURST_SPAN),
    }
    out = all_.withColumns({f"{k}_score": WEIGHTS[k] * c for k, c in parts.items()})
    out = out.withColumn("score", sum(F.col(f"{k}_score") for k in parts))
    verdict = F.when(F.col("score") >= SUITABLE, "suitable").when(F.col("score") >= MARGINAL, "marginal").otherwise("unsuitable")
    return out.select(by, "n", *[f"{k}_score" for k in parts], "score", verdict.alias("verdict"))
