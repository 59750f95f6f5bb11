"""Maximal-overlap wavelets of ordered series: causal as chained windows, circular as a kernel over one key's series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tails

_R3 = math.sqrt(3)
#: Scaling filters of unit norm, by name.
SCALING = {"haar": (1 / math.sqrt(2), 1 / math.sqrt(2)), "d4": tuple(x / (4 * math.sqrt(2)) for x in (1 + _R3, 3 + _R3, 3 - _R3, 1 - _R3))}
#: Which operators use no value from after the row, and which do (and so must not feed a signal).
CAUSAL, NONCAUSAL = ("modwt", "resonance", "conditional_lift"), ("circular", "mra", "scale_energy")


def filters(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Scaling and wavelet filter of the maximal-overlap transform: h[l] = (-1)^l g[L - 1 - l], both over sqrt(2)."""
    g = np.array(SCALING[name])
    return g / math.sqrt(2), (-1.0) ** np.arange(len(g)) * g[::-1] / math.sqrt(2)


def max_level(n: int, wavelet: str = "haar") -> int:
    """The greatest level whose filter is no longer than the series, 1 at least."""
    width, j = len(SCALING[wavelet]), 1
    while (2 ** (j + 1) - 1) * (width - 1) + 1 <= n:
        j += 1
    return j


def modwt(df: DataFrame, levels: int, wavelet: str = "haar", value: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """df with w1 to w<levels> and v<levels>, of values up to each row. What came before the first row counts as zero, so a
    level is null for the rows that its filter overhangs. A missing value is an error."""
    g, h = filters(wavelet)
    order = Window.partitionBy(by).orderBy(ts)
    start = F.when(F.col(value).isNull() | F.isnan(value), F.raise_error(F.lit(f"{value} is missing"))).otherwise(F.col(value))
    df = df.withColumns({"_v0": start.cast("double"), "_i": F.row_number().over(order)})
    for j in range(1, levels + 1):
        back = [F.lag(f"_v{j - 1}", (1 << j - 1) * k, 0.0).over(order) if k else F.col(f"_v{j - 1}") for k in range(len(g))]
        df = df.withColumns({f"_w{j}": sum(float(c) * b for c, b in zip(h, back, strict=True)), f"_v{j}": sum(float(c) * b for c, b in zip(g, back, strict=True))})
    whole = lambda j: F.col("_i") >= (2**j - 1) * (len(g) - 1) + 1
    out = {f"w{j}": F.when(whole(j), F.col(f"_w{j}")) for j in range(1, levels + 1)} | {f"v{levels}": F.when(whole(levels), F.col(f"_v{levels}"))}
    return df.withColumns(out).drop("_i", *[f"_{c}{j}" for j in range(levels + 1) for c in "vw" if (c, j) != ("w", 0)])


def circular(x: np.ndarray, levels: int, wavelet: str = "haar") -> tuple[np.ndarray, np.ndarray]:
    """Wavelet coefficients by level and the last smooth, of a series wrapped round its end."""
    g, h = filters(wavelet)
    v, w = np.asarray(x, float), []
    for j in range(levels):
        back = [np.roll(v, (1 << j) * k) for k in range(len(g))]
        w.append(sum(c * b for c, b in zip(h, back, strict=True)))
        v = sum(c * b for c, b in zip(g, back, strict=True))
    return np.array(w), v


def details(x: np.ndarray, levels: int, wavelet: str = "haar") -> np.ndarray:
    """Details by level and the smooth; the rows add up to x (the transform's adjoint is its inverse)."""
    g, h = filters(wavelet)
    w, v = circular(x, levels, wavelet)
    up = lambda c, f, j: sum(a * np.roll(c, -(1 << j) * k) for k, a in enumerate(f))
    rows = [up(w[j], h, j) for j in range(levels)] + [up(v, g, levels - 1)]
    for n, start in enumerate([*range(levels), levels - 1]):
        for j in range(start - 1, -1, -1):
            rows[n] = up(rows[n], g, j)
    return np.array(rows)


def mra(df: DataFrame, levels: int, wavelet: str = "haar", value: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """by, ts, d1 to d<levels> and s: parts of each value by scale, which add up to it."""
    names = [*(f"d{j}" for j in range(1, levels + 1)), "s"]
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(ts, kind="stable").reset_index(drop=True)
        return pd.concat([p[[by, ts]], pd.DataFrame(details(p[value].to_numpy(float), levels, wavelet).T, columns=names)], axis=1)

    return df.where(F.col(value).isNotNull()).select(by, ts, value).groupBy(by).applyInPandas(run, f"{by} {types[by]}, {ts} {types[ts]}, " + ", ".join(f"{n} double" for n in names))


def scale_energy(df: DataFrame, levels: int, wavelet: str = "haar", value: str = "r", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """by, energy: each level's share, and the smooth's, of the energy of the series less its mean; null without any."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values(ts, kind="stable")[value].to_numpy(float)
        w, v = circular(x - x.mean(), levels, wavelet)
        e = np.array([*(w * w).sum(1), (v * v).sum()])
        return pd.DataFrame([(p[by].iloc[0], (e / e.sum()).tolist() if e.sum() > 0 else None)], columns=[by, "energy"])

    return df.where(F.col(value).isNotNull()).select(by, ts, value).groupBy(by).applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, energy array<double>")


def resonance(df: DataFrame, levels: int, by: str = "symbol", ts: str = "ts", out: str = "resonance", **columns) -> DataFrame:
    """How far the levels point one way: their signs, weighted by their mean squares so far. Null until all levels are."""
    df = modwt(df, levels, by=by, ts=ts, **columns)
    so_far = Window.partitionBy(by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    w = [F.col(f"w{j}") for j in range(1, levels + 1)]
    whole = F.lit(True)
    for x in w:
        whole = whole & x.isNotNull()
    mean = [F.avg(F.when(whole, x * x)).over(so_far) for x in w]
    return df.withColumn(out, F.when(whole, sum(m * F.signum(x) for m, x in zip(mean, w, strict=True)) / F.nullif(sum(mean), F.lit(0.0))))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of a share, within 0 and 1."""
    p = hits / F.nullif(n, F.lit(0))
    middle, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.greatest(F.lit(0.0), (middle - spread) / scale), F.least(F.lit(1.0), (middle + spread) / scale)


def conditional_lift(df: DataFrame, condition: Column, success: Column, group: list[str] | None = None) -> DataFrame:
    """n, n_cond, p_uncond, p_cond, lift, z (pooled), p, low, high, power_warning (under 30 rows, or the interval holds the
    plain share). Rows without an outcome are left out; a missing condition is not met."""
    met = F.coalesce(condition, F.lit(False))
    rows = df.where(success.isNotNull())
    got = rows.groupBy(*(group or [])).agg(F.count("*").alias("n"), F.count_if(met).alias("n_cond"), F.count_if(success).alias("_k"), F.count_if(met & success).alias("_kc"))
    none = lambda c: F.nullif(c, F.lit(0))
    p0, p1 = F.col("_k") / none(F.col("n")), F.col("_kc") / none(F.col("n_cond"))
    pooled = (F.col("_k") + F.col("_kc")) / none(F.col("n") + F.col("n_cond"))
    z = (p1 - p0) / F.nullif(F.sqrt(pooled * (1 - pooled) * (1 / none(F.col("n")) + 1 / none(F.col("n_cond")))), F.lit(0.0))
    low, high = wilson(F.col("_kc"), F.col("n_cond"))
    out = got.withColumns({"p_uncond": p0, "p_cond": p1, "lift": p1 / F.nullif(p0, F.lit(0.0)), "z": z, "low": low, "high": high})
    weak = (F.col("n_cond") < 30) | F.coalesce(F.col("p_uncond").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumns({"p": tails.normal_two_sided(F.col("z")), "power_warning": weak}).drop("_k", "_kc")
