"""Tails of distributions as Column expressions: they run in the JVM, inside whole-stage code where folds allow it."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Published coefficients of rational approximations (erfc; the normal quantile).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x: Column, coefficients) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_two_sided(z: Column) -> Column:
    """Chance that a standard normal value is further from 0 than z (relative error under 1.2e-7)."""
    x = F.abs(z) * math.sqrt(0.5)
    t = 1 / (1 + 0.5 * x)
    return F.least(F.lit(1.0), t * F.exp(-x * x + _poly(t, _ERFC[::-1])))


def normal_cdf(z: Column) -> Column:
    half = normal_two_sided(z) / 2
    return F.when(z < 0, half).otherwise(1 - half)


def normal_quantile(p: Column) -> Column:
    """Relative error under 1.2e-9; null unless 0 < p < 1."""
    tail = lambda q: _poly(F.sqrt(-2 * F.log(q)), _C) / _poly(F.sqrt(-2 * F.log(q)), (*_D, 1.0))
    r = (p - 0.5) * (p - 0.5)
    middle = (p - 0.5) * _poly(r, _A) / _poly(r, (*_B, 1.0))
    return F.when((p > 0) & (p < 0.02425), tail(p)).when((p > 0) & (p <= 0.97575), middle).when((p > 0) & (p < 1), -tail(1 - p))


def log_gamma(x: Column) -> Column:
    z = x + 8
    low = F.log(x)
    for k in range(1, 8):
        low = low + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5)) - low


def _fold(start: Column, step, n: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step)


def _tiny(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-300, 1e-300).otherwise(x)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the method of Lentz."""

    def step(s, k):
        m = k.cast("double")
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / _tiny(1 + even * s["d"]), _tiny(1 + even / s["c"])
        d2, c2 = 1 / _tiny(1 + odd * d1), _tiny(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

    d = 1 / _tiny(1 - (a + b) * x / (a + 1))
    return _fold(F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")), step, 80)["h"]


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    inner = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def t_two_sided(t: Column, df: Column) -> Column:
    """Chance that Student's t with df degrees of freedom is further from 0 than t."""
    df = df.cast("double")
    return beta_share(df / 2, F.lit(0.5), df / (df + t * t))


def chi2_tail(x: Column, df: Column) -> Column:
    """Chance that chi-square with df degrees of freedom is over x, by its series below its mean and a fraction beyond."""
    s, y = df.cast("double") / 2, x / 2
    front = F.exp(s * F.log(y) - y - log_gamma(s))
    series = _fold(F.struct((1 / s).alias("t"), (1 / s).alias("h")), lambda a, k: F.struct((a["t"] * y / (s + k)).alias("t"), (a["h"] + a["t"] * y / (s + k)).alias("h")), 200)["h"]

    def step(a, k):
        m = k.cast("double")
        an, bn = -m * (m - s), y + 1 - s + 2 * m
        d, c = 1 / _tiny(an * a["d"] + bn), _tiny(bn + an / a["c"])
        return F.struct(c.alias("c"), d.alias("d"), (a["h"] * c * d).alias("h"))

    d = 1 / _tiny(y + 1 - s)
    fraction = _fold(F.struct(F.lit(1e300).alias("c"), d.alias("d"), d.alias("h")), step, 100)["h"]
    return F.when(x <= 0, 1.0).when(y < s + 1, 1 - front * series).otherwise(front * fraction)
