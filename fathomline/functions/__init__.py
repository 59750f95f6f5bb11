"""Distribution tails and other scalar functions that SQL engines lack."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, functions as F

NORMAL = NormalDist()


def chi2_tail(x: float, k: float) -> float:
    """P(chi-squared with k degrees of freedom > x), by the series or continued fraction of the incomplete gamma."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def t_tail(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|) with df degrees of freedom, by the incomplete beta's continued fraction."""
    x = df / (df + t * t)

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        return h

    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def probabilistic_sharpe(sr: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    """Chance that the true Sharpe ratio exceeds the benchmark; kurt is not in excess."""
    return NORMAL.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(max(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """Expected best Sharpe ratio of independent trials without skill; 0 for one trial."""
    if trials <= 1:
        return 0.0
    g = 0.5772156649015329
    return math.sqrt(variance) * ((1 - g) * NORMAL.inv_cdf(1 - 1 / trials) + g * NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurt: float, variance: float, trials: int) -> float:
    return probabilistic_sharpe(sr, n, skew, kurt, expected_max_sharpe(variance, trials))


def nfkc(c: Column) -> Column:
    """Unicode normalisation, form NFKC (Arrow batches; no built-in does it)."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return run(c)


def stable_hash(*parts: Column) -> Column:
    """First 16 hex digits of the sha1 of all parts, each closed by a zero character."""
    return F.substring(F.sha1(F.concat(*[x for p in parts for x in (p, F.lit("\x00"))])), 1, 16)


def t_quantile(p: float, df: float) -> float:
    """The value of Student's t below which a share p of the distribution lies, by halving."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        below = 1 - t_tail(mid, df) / 2 if mid > 0 else t_tail(mid, df) / 2
        lo, hi = (mid, hi) if below < p else (lo, mid)
    return (lo + hi) / 2
