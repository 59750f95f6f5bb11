"""Signals, selections and simulations: expressions and windows where rows do not depend on decisions before them, ordered
groups in Python where they do (state machines)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def sector_deciles(df: DataFrame, score: str, share: float, by: str = "ts", sector: str | None = None, key: str = "symbol", long_only: bool = False, reverse: bool = False, out: str = "leg") -> DataFrame:
    """long for the best and short for the worst share of each date (and sector), at least one each; ties by key."""
    part = Window.partitionBy(by, *([sector] if sector else []))
    best, worst = (F.asc, F.desc) if reverse else (F.desc, F.asc)
    n = F.greatest(F.lit(1), half_even(F.count(score).over(part) * F.lit(share))).cast("int")
    df = df.withColumns({"_n": n, "_hi": F.row_number().over(part.orderBy(F.col(score).isNull(), best(score), key)), "_lo": F.row_number().over(part.orderBy(F.col(score).isNull(), worst(score), F.desc(key)))})
    leg = F.when(F.col(score).isNull(), "flat").when(F.col("_hi") <= F.col("_n"), "long")
    if not long_only:
        leg = leg.when(F.col("_lo") <= F.col("_n"), "short")
    return df.withColumn(out, leg.otherwise("flat")).drop("_n", "_hi", "_lo")


def betas(df: DataFrame, ret: str, market: str, window: int = 60, least: int = 10, by: str = "symbol", ts: str = "ts", out: str = "beta") -> DataFrame:
    w = Window.partitionBy(by).orderBy(ts).rowsBetween(1 - window, 0)
    both = F.col(ret).isNotNull() & F.col(market).isNotNull()
    x, m = F.when(both, F.col(ret)), F.when(both, F.col(market))
    return df.withColumn(out, F.when(F.count(x).over(w) >= least, F.covar_samp(x, m).over(w) / F.nullif(F.var_samp(m).over(w), F.lit(0.0))))


def basket_hedge(df: DataFrame, weight: str = "weight", beta: str = "beta", by: str = "ts", limit: float = 2.0) -> DataFrame:
    """by, basket_beta (weights times betas), hedge (its opposite, within the limit)."""
    b = F.coalesce(F.sum(F.col(weight) * F.col(beta)), F.lit(0.0))
    return df.groupBy(by).agg(b.alias("basket_beta")).withColumn("hedge", F.greatest(F.lit(-limit), F.least(F.lit(limit), 0.0 - F.col("basket_beta"))))


def threshold_policy(direction: Column, confidence: Column, threshold: float, exposure: float = 1.0) -> Column:
    """Direction times exposure where the confidence clears the threshold, else 0."""
    return F.coalesce(F.when(confidence >= threshold, direction).otherwise(0.0) * exposure, F.lit(0.0))


def simulate(df: DataFrame, weight: str, price: str, ret: str, capital: float = 1e7, point_value: float = 50.0, fee: float = 0.0, slippage: float = 0.0, whole: bool = True, by: str = "symbol", ts: str = "ts", out: str = "pnl") -> DataFrame:
    """df with `held` and the return of each row: weights set at a close earn from the next row on, where their cost is
    paid too. A missing weight carries the one before; whole contracts are rounded half to even."""
    order = Window.partitionBy(by).orderBy(ts)
    carried = F.coalesce(F.last(weight, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    df = df.withColumn("held", carried)
    if whole:
        df = df.withColumn("held", half_even(F.col("held") * capital / (F.col(price) * point_value)) * F.col(price) * point_value / capital)
    df = df.withColumn("_t", F.abs(F.col("held") - F.coalesce(F.lag("held").over(order), F.lit(0.0))) * (fee + slippage * point_value) / (F.col(price) * point_value))
    return df.withColumn(out, F.coalesce(F.lag("held").over(order), F.lit(0.0)) * F.col(ret) - F.coalesce(F.lag("_t").over(order), F.lit(0.0)) + 0.0).drop("_t")


def fold_plan(n: int, train: int, test: int, embargo: int = 1, scheme: str = "anchored") -> list[tuple[int, int, int, int]]:
    """(train start, train end, test start, test end) of contiguous windows over n rows; ends are one beyond."""
    if train < 1 or test < 1 or embargo < 0 or scheme not in ("anchored", "rolling"):
        raise ValueError("bad plan")
    first = lambda end: max(0, end - train) if scheme == "rolling" else 0
    return [(first(at - embargo), at - embargo, at, min(n, at + test)) for at in range(train + embargo, n, test)]


def nested_walk_forward(df: DataFrame, thresholds: list[float], n: int, train: int, test: int, embargo: int = 1, scheme: str = "anchored", exposure: float = 1.0, periods: float = 252, by: str = "symbol", ts: str = "ts", **sim) -> DataFrame:
    """A row for each key and fold: the threshold with the best Sharpe ratio on training rows (the first at ties), its
    ratios there and on the test rows, and its return there. df: direction, confidence, price, ret by key and time; n: the
    longest key's rows. The grid and the plan are small tables that are joined to the rows."""
    spark = df.sparkSession
    grid = spark.createDataFrame(list(enumerate(map(float, thresholds))), "g int, threshold double")
    plan = spark.createDataFrame([(i, *p) for i, p in enumerate(fold_plan(n, train, test, embargo, scheme))], "fold int, a int, b int, c int, d int")
    each = df.crossJoin(F.broadcast(grid)).withColumn("_w", F.when(F.col("confidence") >= F.col("threshold"), F.col("direction")).otherwise(0.0) * exposure)
    each = each.withColumn("_key", F.concat_ws("|", by, "g"))
    each = simulate(each, "_w", "price", "ret", by="_key", ts=ts, **sim)
    each = each.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy(ts)) - 1)
    inside = (F.col("_k") >= F.col("a")) & (F.col("_k") < F.col("b"))
    outside = (F.col("_k") >= F.col("c")) & (F.col("_k") < F.col("d"))
    root = math.sqrt(periods)

    def sharpe(cond):
        x = F.when(cond, F.col("pnl"))
        return F.coalesce(F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * root, F.lit(0.0))

    got = each.join(F.broadcast(plan), inside | outside).groupBy(by, "fold", "g", "threshold").agg(sharpe(inside).alias("is_sharpe"), sharpe(outside).alias("oos_sharpe"), (F.exp(F.sum(F.when(outside, F.log1p("pnl")))) - 1).alias("oos_return"), F.count_if(outside).alias("n"))
    best = F.row_number().over(Window.partitionBy(by, "fold").orderBy(F.desc("is_sharpe"), "g"))
    return got.where("n > 0").withColumn("_r", best).where("_r = 1").select(by, "fold", F.col("threshold").alias("chosen"), "is_sharpe", "oos_sharpe", "oos_return")


def _machine(df: DataFrame, run, by: str, ts: str, columns: list[str], schema: str) -> DataFrame:
    return df.select(by, ts, *columns).groupBy(by).applyInPandas(lambda p: run(p.sort_values(ts, kind="stable").reset_index(drop=True)), schema)


def timing_legs(df: DataFrame, score: str = "score", legs: int = 3, gate: float = 0.6, leave: float = 0.3, cooldown: int = 5, by: str = "symbol", ts: str = "ts", kind: str = "date") -> DataFrame:
    """by, ts, legs: legs are added one at a time while the score clears the gate and `cooldown` rows have passed since
    the last, and all go when it falls to `leave`."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        held, since, out = 0, cooldown, []
        for s in p[score]:
            since += 1
            if s <= leave and held:
                held, since = 0, cooldown
            elif s >= gate and held < legs and since >= cooldown:
                held, since = held + 1, 0
            out.append(held)
        return p[[by, ts]].assign(legs=out)

    return _machine(df, run, by, ts, [score], f"{by} string, {ts} {kind}, legs long")


def tail_hedge(df: DataFrame, price: str = "close", lookback: int = 20, margin: float = 0.03, steps: tuple[float, ...] = (0.05, 0.10, 0.15), by: str = "symbol", ts: str = "ts", kind: str = "date") -> DataFrame:
    """by, ts, position: short one unit when a breakout of the row before fades below the earlier high by the margin; a
    third goes at each further gain in `steps`, all at the last or when the price is back at that high."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x, pos, high, done, out = p[price].to_numpy(float), 0.0, 0.0, 0, []
        for i, now in enumerate(x):
            if pos == 0 and i + 1 >= lookback:
                prior = x[i + 1 - lookback : i].max()
                if x[i - 1] >= prior and now <= prior * (1 - margin):
                    pos, high, done = -1.0, prior, 0
            elif pos < 0:
                if now >= high:
                    pos = 0.0
                elif (high - now) / high >= steps[done]:
                    done += 1
                    pos = 0.0 if done == len(steps) else pos * 2 / 3
            out.append(pos)
        return p[[by, ts]].assign(position=out)

    return _machine(df, run, by, ts, [price], f"{by} string, {ts} {kind}, position double")


def event_hold(events: DataFrame, sessions: DataFrame, hold: int, capacity: int, group: str = "g", day: str = "d", key: str = "symbol") -> DataFrame:
    """group, day, n_positions, opened, skipped: positions age first, so that a place freed today can be taken today; then
    the day's events open, in the order of their keys, while there are under `capacity`; a key that is held is passed over.

    sessions: (group, day). A group is one book, replayed in one task.
    """
    at = sessions.select(group, day, F.lit(None).cast("string").alias(key)).distinct().unionByName(events.select(group, day, F.col(key).cast("string").alias(key)))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        out = []
        for d, rows in p.sort_values([day, key], kind="stable", na_position="first").groupby(day, sort=True):
            held = {k: n - 1 for k, n in held.items() if n > 1}
            opened = skipped = 0
            for k in rows[key].dropna():
                if len(held) >= capacity:
                    skipped += 1
                elif k not in held:
                    held[k] = hold
                    opened += 1
            out.append((p[group].iloc[0], d, len(held), opened, skipped))
        return pd.DataFrame(out, columns=[group, day, "n_positions", "opened", "skipped"])

    return at.groupBy(group).applyInPandas(run, f"{group} string, {day} date, n_positions long, opened long, skipped long")


def event_window(df: DataFrame, flag: str, before: int, after: int, by: str = "symbol", ts: str = "ts", out: str = "inside") -> DataFrame:
    """Whether a row lies from `before` rows ahead of a flagged row to `after` rows behind one."""
    w = Window.partitionBy(by).orderBy(ts).rowsBetween(-after, before)
    return df.withColumn(out, F.coalesce(F.max(F.col(flag).cast("int")).over(w) == 1, F.lit(False)))


def regime_overlay(df: DataFrame, weights: DataFrame, on: list[str], weight: str = "w", default: float = 1.0, out: str = "overlay") -> DataFrame:
    """The overlay's weight of a row's date, kept within 0 and 1, or the default."""
    o = weights.select(*on, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(weight))).alias(out))
    return df.join(o, on, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def complexity_gap(df: DataFrame, value: str = "r", group: str = "g", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """group, n, periods, gap: the greatest eigenvalue of the correlation matrix over its size, less the mean correlation.

    Only keys with a value at every time of the group take part; under 5 of them or 30 times give null. Correlations are
    taken in the cluster, pair by pair of keys; a group's matrix goes to one task.
    """
    times = df.groupBy(group).agg(F.countDistinct(ts).alias("_t"))
    whole = df.where(F.col(value).isNotNull()).groupBy(group, by).agg(F.countDistinct(ts).alias("_n")).join(times, group).where("_n = _t").select(group, by, "_t")
    x = df.join(whole, [group, by])
    part = Window.partitionBy(group, by)
    x = x.withColumn("_z", (F.col(value) - F.avg(value).over(part)) / F.coalesce(F.nullif(F.stddev_samp(value).over(part), F.lit(0.0)), F.lit(1.0))).select(group, by, ts, "_z", "_t")
    y = x.select(group, ts, F.col(by).alias("_b"), F.col("_z").alias("_y"))
    c = x.join(y, [group, ts]).groupBy(group, by, "_b").agg((F.sum(F.col("_z") * F.col("_y")) / (F.max("_t") - 1)).alias("_c"), F.max("_t").alias("_t"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot(index=by, columns="_b", values="_c").to_numpy(float)
        n, t = len(m), int(p["_t"].iloc[0])
        gap = float(np.linalg.eigvalsh(m)[-1] / n - (m.sum() - np.trace(m)) / (n * (n - 1))) if n >= 5 and t >= 30 else None
        return pd.DataFrame([(str(p[group].iloc[0]), n, t, gap)], columns=[group, "n", "periods", "gap"])

    return c.groupBy(group).applyInPandas(run, f"{group} string, n long, periods long, gap double")


def memorization(df: DataFrame, guess: str = "guess", actual: str = "actual", day: str = "day", cutoff: str = "2024-01-01") -> DataFrame:
    """Recall before and after a cutoff: n, answered, median absolute error in per cent of each side, and whether a leak is
    suspected (half answered before, error under 3, and under half of that after)."""
    err = F.when(F.col(guess) > 0, F.abs(F.col(guess) / F.col(actual) - 1) * 100)
    pre, post = F.col(day) < F.lit(cutoff), F.col(day) >= F.lit(cutoff)
    one = lambda c: F.percentile(F.when(c, err), F.lit(0.5))
    out = df.agg(F.count_if(pre).alias("n_pre"), F.count(F.when(pre, err)).alias("answered_pre"), one(pre).alias("median_pre"), F.count_if(post).alias("n_post"), F.count(F.when(post, err)).alias("answered_post"), one(post).alias("median_post"))
    leak = (F.col("answered_pre") > 0) & (F.col("answered_pre") >= 0.5 * F.col("n_pre")) & (F.col("median_pre") < 3) & (F.col("median_post").isNull() | (F.col("median_pre") < 0.5 * F.col("median_post")))
    return out.withColumn("leak_suspected", F.coalesce(leak, F.lit(False)))


def replay(bars: DataFrame, decisions: DataFrame, by: str = "symbol", ts: str = "ts", at: str = "decided") -> DataFrame:
    """Bars with the decision in force: the last one at or before each bar (null before the first)."""
    names = [c for c in decisions.columns if c not in (by, at)]
    d = decisions.select(by, F.col(at).alias(ts), F.struct(F.col(at).alias(at), *names).alias("_d"), F.lit(0).alias("_s"))
    both = bars.select(by, ts, F.struct(*[c for c in bars.columns if c not in (by, ts)]).alias("_b"), F.lit(1).alias("_s")).unionByName(d, allowMissingColumns=True)
    last = F.last("_d", ignorenulls=True).over(Window.partitionBy(by).orderBy(ts, "_s").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_d", last).where("_s = 1").select(by, ts, "_b.*", "_d.*")


def trim_tail_zeros(df: DataFrame, value: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows up to the last one of each key whose value is not 0."""
    last = F.max(F.when(F.col(value) != 0, F.col(ts))).over(Window.partitionBy(by))
    return df.withColumn("_l", last).where(F.col(ts) <= F.col("_l")).drop("_l")


def covered(df: DataFrame, column: str, most: float = 0.05) -> DataFrame:
    """df, unless more than the given share of a column is null: then an error."""
    share = df.agg(F.avg(F.col(column).isNull().cast("double"))).first()[0]
    if share is not None and share > most:
        raise ValueError(f"{column}: {share:.1%} of the rows are null, over {most:.1%}")
    return df


def front(df: DataFrame, by: list[str], volume: str = "volume", expiry: str = "expiry") -> DataFrame:
    """The contract with the most volume of each root and date; the nearer expiry at ties."""
    w = Window.partitionBy(*by).orderBy(F.desc(volume), expiry)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def panel(df: DataFrame, price: str = "close", by: str = "symbol", ts: str = "ts", months: int = 12, skip: int = 1) -> DataFrame:
    """A row for each key and month (its first row): mom (log change over `months`, without the last `skip`), vol (of the
    last 6 changes), rev (last change), fwd_ret (next change), other_mom (mean mom of the other keys in the month)."""
    m = df.withColumn("month", F.trunc(ts, "month"))
    m = m.withColumn("_r", F.row_number().over(Window.partitionBy(by, "month").orderBy(ts))).where("_r = 1").select(by, "month", F.log(price).alias("_p"))
    w = Window.partitionBy(by).orderBy("month")
    step = F.col("_p") - F.lag("_p").over(w)
    m = m.withColumns({"mom": F.lag("_p", skip).over(w) - F.lag("_p", months).over(w), "rev": step, "fwd_ret": F.lead("_p").over(w) - F.col("_p")})
    m = m.withColumn("vol", F.stddev_samp("rev").over(w.rowsBetween(-5, 0)))
    d = Window.partitionBy("month")
    n = F.count("mom").over(d) - F.col("mom").isNotNull().cast("int")
    return m.withColumn("other_mom", (F.sum("mom").over(d) - F.coalesce("mom", F.lit(0.0))) / F.nullif(n, F.lit(0))).drop("_p")
