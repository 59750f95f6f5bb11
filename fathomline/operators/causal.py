"""Effects of a treatment on an outcome in a panel of rows by period, with linear confounders.

Sums of products are taken by fold, period or block in one aggregate; only those small tables reach the driver, and
residuals are Column expressions with the solved coefficients.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import t_quantile, t_tail


def fold_ids(df: DataFrame, n: int, cluster: str | None = None, seed: int = 0, out: str = "fold") -> DataFrame:
    """Rows, or whole clusters, dealt to n folds by a seeded hash: any executor finds the same folds again."""
    key = F.xxhash64(F.col(cluster), F.lit(seed)) if cluster else F.xxhash64(*df.columns, F.lit(seed))
    return df.withColumn(out, F.pmod(key, F.lit(n)).cast("int"))


def _names(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _grams(df: DataFrame, by: str, columns: list[str]) -> tuple[list, np.ndarray]:
    """Values of `by` in order, and for each the sums of products of (1, columns)."""
    x: list[Column] = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    rows = df.groupBy(by).agg(*[F.sum(x[i] * x[j]).alias(f"_{i}_{j}") for i, j in _names(len(x))]).orderBy(by).collect()  # a row a fold, period or block
    out = np.zeros((len(rows), len(x), len(x)))
    for r, row in enumerate(rows):
        for i, j in _names(len(x)):
            out[r, i, j] = out[r, j, i] = row[f"_{i}_{j}"]
    return [r[by] for r in rows], out


def _solve(gram: np.ndarray, target: int, of: list[int]) -> np.ndarray:
    return np.linalg.lstsq(gram[np.ix_(of, of)], gram[of, target], rcond=None)[0]


def cross_fit_residuals(df: DataFrame, targets: list[str], confounders: list[str], fold: str = "fold") -> DataFrame:
    """df with res_<target>: each target less its least-squares prediction from the confounders, fitted on the other folds."""
    keys, grams = _grams(df, fold, [*confounders, *targets])
    k = len(confounders) + 1
    for t, name in enumerate(targets):
        case = F.lit(None).cast("double")
        for key, gram in zip(keys, grams, strict=True):
            b = _solve(grams.sum(0) - gram, k + t, list(range(k)))
            line = F.lit(float(b[0]))
            for c, w in zip(confounders, b[1:], strict=True):
                line = line + float(w) * F.col(c)
            case = F.when(F.col(fold) == key, F.col(name) - line).otherwise(case)
        df = df.withColumn(f"res_{name}", case)
    return df


@dataclass
class Effect:
    theta: float
    se: float
    p: float
    low: float
    high: float
    n: int
    clusters: int | None
    se_iid: float


def select_confounders(candidates: list[str]) -> list[str]:
    """All of them: leaving some out by a search on the data would change what is controlled for."""
    return list(candidates)


def plr_effect(df: DataFrame, treatment: str, outcome: str, confounders: list[str], cluster: str | None = None, n_folds: int = 5, seed: int = 0, least: int = 50) -> Effect:
    """Partially linear effect by cross-fitting: sum of products of residuals over the treatment's, with standard errors by
    cluster (G / (G - 1), Student's t with G - 1 degrees of freedom) where one is named."""
    df = df.dropna(subset=[treatment, outcome, *confounders, *([cluster] if cluster else [])])
    parts = cross_fit_residuals(fold_ids(df, n_folds, cluster, seed), [outcome, treatment], confounders)
    d, y = F.col(f"res_{treatment}"), F.col(f"res_{outcome}")
    n, dd, dy = parts.agg(F.count("*"), F.sum(d * d), F.sum(d * y)).first()
    if n < least:
        raise ValueError(f"too few rows: {n}")
    if not dd or dd <= 0:
        raise ValueError("no variation of the treatment is left")
    theta = dy / dd
    psi = d * (y - theta * d)
    iid = math.sqrt(parts.agg(F.sum(psi * psi)).first()[0]) / dd
    if cluster is None:
        z = 1.959963984540054
        return Effect(theta, iid, math.erfc(abs(theta / iid) / math.sqrt(2)), theta - z * iid, theta + z * iid, n, None, iid)
    g, s = parts.groupBy(cluster).agg(F.sum(psi).alias("s")).agg(F.count("*"), F.sum(F.col("s") * F.col("s"))).first()
    if g < max(n_folds, 3):
        raise ValueError("too few clusters")
    se = math.sqrt(g / (g - 1) * s) / dd
    t = t_quantile(0.975, g - 1)
    return Effect(theta, se, t_tail(theta / se, g - 1), theta - t * se, theta + t * se, n, g, iid)


def _partial(gram: np.ndarray) -> float:
    """Slope of the last variable on the one before it, both less their fit on all others."""
    k = len(gram)
    z = list(range(k - 2))
    bd, by = _solve(gram, k - 2, z), _solve(gram, k - 1, z)
    dd = gram[k - 2, k - 2] - bd @ gram[z, k - 2]
    return float((gram[k - 2, k - 1] - bd @ gram[z, k - 1]) / dd) if dd > 1e-12 else math.nan


def newey_west(x: np.ndarray, lags: int) -> float:
    """Long-run variance with Bartlett weights."""
    x = x - x.mean()
    n = len(x)
    return float(x @ x / n + sum(2 * (1 - k / (lags + 1)) * (x[k:] @ x[:-k]) / n for k in range(1, min(lags, n - 1) + 1)))


def fama_macbeth(df: DataFrame, treatment: str, outcome: str, confounders: list[str], period: str, least: int = 30, lags: int = 6) -> dict:
    """Mean of the slopes by period, with a t of Newey and West. Periods with under `least` rows are left out."""
    df = df.dropna(subset=[period, treatment, outcome, *confounders])
    _, grams = _grams(df, period, [*confounders, treatment, outcome])
    slopes = np.array([_partial(g) for g in grams if g[0, 0] >= max(least, len(confounders) + 3)])
    slopes = slopes[np.isfinite(slopes)]
    if len(slopes) < 12:
        raise ValueError(f"too few periods: {len(slopes)}")
    se = math.sqrt(newey_west(slopes, lags) / len(slopes))
    return {"periods": len(slopes), "mean": float(slopes.mean()), "t": float(slopes.mean() / se), "share_positive": float((slopes > 0).mean())}


def block_signs(df: DataFrame, treatment: str, outcome: str, confounders: list[str], effect: float, period: str | None = None, blocks: int = 10, share: float = 0.7, draws: int = 50, seed: int = 0) -> dict:
    """Whether the slope keeps the effect's sign over contiguous blocks of periods (a share of 0.7), or without periods over
    seeded subsets of 70 % of the rows (over 0.9 of them)."""
    df = df.dropna(subset=[treatment, outcome, *confounders, *([period] if period else [])])
    columns = [*confounders, treatment, outcome]
    if period is None:
        parts, grams = 10, None
        _, grams = _grams(fold_ids(df, 100, seed=seed, out="_part"), "_part", columns)
        rng = np.random.default_rng(seed)
        signs = [np.sign(_partial(grams[rng.choice(len(grams), max(parts, int(0.7 * len(grams))), replace=False)].sum(0))) for _ in range(draws)]
        got = float((np.array(signs) == np.sign(effect)).mean())
        return {"share": got, "blocks": draws, "passed": got > 0.9, "method": "row_subsets"}
    _, grams = _grams(df, period, columns)
    n = min(blocks, max(2, len(grams) // 6))
    sums = [part.sum(0) for part in np.array_split(grams, n)]
    slopes = np.array([_partial(g) for g in sums if g[0, 0] > len(confounders) + 3])
    slopes = slopes[np.isfinite(slopes)]
    got = float((np.sign(slopes) == np.sign(effect)).mean()) if len(slopes) and effect else 0.0
    return {"share": got, "blocks": len(slopes), "passed": got >= share, "method": "time_blocks"}


def verdict(df: DataFrame, treatment: str, outcome: str, confounders: list[str], period: str | None = None, alpha: float = 0.05, seed: int = 0) -> dict:
    """PASS: both tests clear alpha with one sign, and blocks keep it. CONDITIONAL: blocks do not, or there are no periods.
    FAIL: a test does not clear."""
    effect = plr_effect(df, treatment, outcome, select_confounders(confounders), period, seed=seed)
    clear = effect.p < alpha
    by_period = fama_macbeth(df, treatment, outcome, confounders, period) if period else None
    if by_period:
        clear &= abs(by_period["t"]) >= t_quantile(1 - alpha / 2, by_period["periods"] - 1) and np.sign(by_period["mean"]) == np.sign(effect.theta)
    signs = block_signs(df, treatment, outcome, confounders, effect.theta, period, seed=seed)
    word = "FAIL" if not clear else "PASS" if period and signs["passed"] else "CONDITIONAL"
    return {"verdict": word, "effect": effect, "by_period": by_period, "signs": signs}
