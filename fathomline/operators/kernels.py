"""Numeric kernels over one ordered group: bootstrap tests of snooping, online false discovery control, fluctuation
analysis, circular wavelets and simulated drawdowns. A group is one panel or series, sent whole to a task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def stationary_indices(n: int, draws: int, block: float, seed: int) -> np.ndarray:
    """draws x n positions: blocks of geometric length with mean `block`, wrapped round the end."""
    rng = np.random.default_rng(seed)
    fresh = rng.random((draws, n)) < 1 / block
    fresh[:, 0] = True
    start = rng.integers(0, n, (draws, n))
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
    return (np.take_along_axis(start, at, 1) + np.arange(n) - at) % n


def snooping(panel: np.ndarray, draws: int = 500, block: float = 10, seed: int = 7, level: float = 0.05) -> dict:
    """Reality check, superior predictive ability (consistent) and step-wise rejections for a T x M panel of
    performances against zero. p-values count draws strictly above the statistic."""
    t, m = panel.shape
    mean = panel.mean(0)
    at = stationary_indices(t, draws, block, seed)
    weights = np.apply_along_axis(np.bincount, 1, at, minlength=t) / t
    boot = weights @ panel
    scale = np.maximum(np.sqrt(t) * (boot - mean).std(0), 1e-12)
    root = math.sqrt(t)
    rc = (root * mean).max()
    p_rc = float(((root * (boot - mean)).max(1) > rc).mean())
    keep = np.where(root * mean / scale >= -math.sqrt(2 * math.log(math.log(max(t, 3)))), mean, 0)
    spa = max(0.0, (root * mean / scale).max())
    p_spa = float((np.maximum(0, (root * (boot - keep) / scale).max(1)) > spa).mean())
    left, rejected = np.ones(m, bool), np.zeros(m, bool)
    while left.any():
        cut = np.quantile((root * (boot - mean)[:, left] / scale[left]).max(1), 1 - level)
        new = left & (root * mean / scale > cut)
        if not new.any():
            break
        rejected |= new
        left &= ~new
    return {"models": m, "periods": t, "p_white": p_rc, "p_spa": p_spa, "rejected": int(rejected.sum())}


def snooping_report(df: DataFrame, group: str, ts: str, model: str, value: str, **more) -> DataFrame:
    """One row for each group's panel (long: group, ts, model, value); missing cells are 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        panel = pdf.pivot_table(index=ts, columns=model, values=value, aggfunc="sum").sort_index().fillna(0.0)
        return pd.DataFrame([{"grp": str(pdf[group].iloc[0])} | snooping(panel.to_numpy(), **more)])

    return df.select(group, ts, model, value).groupBy(group).applyInPandas(run, "grp string, models long, periods long, p_white double, p_spa double, rejected long")


def addis(p: np.ndarray, alpha: float = 0.05, tau: float = 0.5, lam: float = 0.25) -> np.ndarray:
    """Levels of the adaptive discarding rule, in order of the tests; a missing p-value is an error.

    Spending follows j ** -1.6. A test above tau is discarded at level 0; one at or under lam * tau is a candidate and is
    not paid for. A test is rejected when p / tau is at most its level.
    """
    if np.isnan(p).any():
        raise ValueError("missing p-value")
    n = len(p)
    gamma = np.arange(1, n + 2) ** -1.6
    gamma /= (np.arange(1, 100_001) ** -1.6).sum()
    out = np.empty(n)
    w0 = alpha / 2
    kept = np.cumsum(p <= tau)
    cand = np.cumsum((p <= tau) & (p / tau <= lam))
    # a rejection's payment depends only on how many tests were paid for since; the sum is taken anew when that changes
    paid = np.concatenate([[0], kept - cand])
    pays = np.zeros(n + 1)  # by the number of tests paid for before
    pays[0] = w0
    first, at, total = True, 0, w0 * gamma[0]
    for t in range(n):
        if paid[t] != at:
            at = paid[t]
            total = float(pays[: at + 1] @ gamma[at::-1])
        if p[t] > tau:
            out[t] = 0.0
            continue
        out[t] = min(tau * lam, (tau - lam) * total)
        if p[t] / tau <= out[t]:
            pay = alpha - w0 if first else alpha
            first = False
            pays[paid[t + 1]] += pay
            if paid[t + 1] == at:
                total += pay * gamma[0]
    return out


def online_fdr(df: DataFrame, group: str, order: list[str], p: str, alpha: float = 0.05, tau: float = 0.5, lam: float = 0.25) -> DataFrame:
    """Replays each group's tests in order: seq, p, level, rejected."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf[p].to_numpy(float)
        level = addis(x, alpha, tau, lam)
        return pd.DataFrame({"grp": pdf[group].astype(str), "seq": np.arange(len(x)), "p": x, "level": level, "rejected": (x <= tau) & (x / tau <= level)})

    return df.select(*{group, *order, p}).groupBy(group).applyInPandas(run, "grp string, seq long, p double, level double, rejected boolean")


def dfa(x: np.ndarray, order: int = 1, scales: int = 16) -> float:
    """Slope of log fluctuation on log block size, over blocks from both ends; NaN with fewer than 4 sizes."""
    y = np.cumsum(x - x.mean())
    n = len(y)
    sizes = np.unique(np.geomspace(max(order + 2, 4), max(n // 4, 5), scales).astype(int))
    sizes = sizes[(sizes <= n // 2) & (sizes > order + 1)]
    if len(sizes) < 4:
        return math.nan
    f = []
    for s in sizes:
        k = n // s
        blocks = np.concatenate([y[: k * s].reshape(k, s), y[n - k * s :].reshape(k, s)])
        design = np.vander(np.arange(s) / s, order + 1)
        fit = np.linalg.lstsq(design, blocks.T, rcond=None)[0]
        f.append(math.sqrt(((blocks.T - design @ fit) ** 2).mean()))
    return float(np.polyfit(np.log(sizes), np.log(np.maximum(f, 1e-300)), 1)[0])


def modwt(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Circular Haar wavelet coefficients by level, and the last smooth."""
    v, w = x.astype(float), []
    for j in range(levels):
        back = np.roll(v, 1 << j)
        w.append((v - back) / 2)
        v = (v + back) / 2
    return np.array(w), v


def mra(x: np.ndarray, levels: int) -> np.ndarray:
    """Details by level and the smooth; the rows add up to x."""
    w, v = modwt(x, levels)

    def up(c: np.ndarray, j: int, sign: int) -> np.ndarray:
        return (c + sign * np.roll(c, -(1 << j))) / 2

    rows = []
    for j in range(levels):
        d = up(w[j], j, -1)
        for k in range(j - 1, -1, -1):
            d = up(d, k, 1)
        rows.append(d)
    s = v
    for k in range(levels - 1, -1, -1):
        s = up(s, k, 1)
    return np.array([*rows, s])


def by_series(df: DataFrame, group: str, ts: str, value: str, levels: int = 3) -> DataFrame:
    """Hurst exponent by fluctuation analysis, and each scale's share of energy in the circular transform."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(ts)[value].to_numpy(float)
        w, v = modwt(x - x.mean(), levels)
        e = np.array([*(w**2).sum(1), (v**2).sum()])
        return pd.DataFrame([{"grp": str(pdf[group].iloc[0]), "n": len(x), "hurst_dfa": dfa(x), "energy": (e / e.sum() if e.sum() > 0 else e * math.nan).tolist()}])

    return df.where(f"{value} is not null").select(group, ts, value).groupBy(group).applyInPandas(run, "grp string, n long, hurst_dfa double, energy array<double>")


def simulated_drawdown(mu: float, sigma: float, horizon: int, paths: int, seed: int) -> float:
    """Mean maximum drawdown of Gaussian walks."""
    rng = np.random.default_rng(seed)
    total = 0.0
    for lo in range(0, paths, 1000):
        walk = np.cumsum(rng.normal(mu, sigma, (min(1000, paths - lo), horizon)), 1)
        top = np.maximum(np.maximum.accumulate(walk, 1), 0)
        total += (top - walk).max(1).sum()
    return total / paths


def visibility_rsi(x: np.ndarray) -> float:
    """Share, in percent, of rising among the earlier points that the last one sees; 50 if it sees none of a kind."""
    n, top, up, down = len(x), -math.inf, 0, 0
    for k in range(n - 2, -1, -1):
        slope = (x[k] - x[-1]) / (n - 1 - k)
        if slope > top:
            top = slope
            up, down = up + (x[k] < x[-1]), down + (x[k] > x[-1])
    return 100 * up / (up + down) if up + down else 50.0
