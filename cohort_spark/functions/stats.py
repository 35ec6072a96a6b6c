"""Small numeric functions: column expressions, and p-values over driver-sized results."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column, default: float = 0.0) -> Column:
    """``default`` for NaN, infinity and null."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(default)).otherwise(c)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sentinel_clip(c: Column, above: float = 6.0, sentinel: float = 7.0) -> Column:
    """Values beyond the observation window become one sentinel, so that they tell nothing of the future."""
    return F.when(c > above, F.lit(sentinel)).otherwise(c)


def chi2_pvalue(chi2: float | None) -> float | None:
    """Upper tail of chi-square with one degree of freedom."""
    return None if chi2 is None else math.erfc(math.sqrt(chi2 / 2))


def ks_pvalue(statistic: float | None, n: int, m: int) -> float | None:
    """Asymptotic two-sided Kolmogorov-Smirnov p-value."""
    if statistic is None or not n or not m:
        return None
    t = statistic * math.sqrt(n * m / (n + m))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * t) ** 2) for k in range(1, 101))))


def correlation_pvalue(rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a rank correlation by Fisher's normal approximation."""
    if rho is None or n < 4 or abs(rho) >= 1:
        return 0.0 if rho is not None and n >= 4 else None
    return 2 * (1 - NormalDist().cdf(abs(math.atanh(rho)) * math.sqrt(n - 3)))


def bca_percentiles(share_below: float, acceleration: float, level: float = 0.95) -> tuple[float, float]:
    """Percentiles (0 to 100) of the bias-corrected and accelerated interval, kept within [0.1, 99.9]."""
    normal = NormalDist()
    z0 = normal.inv_cdf(min(max(share_below, 1e-6), 1 - 1e-6))
    out = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(p)
        out.append(min(max(100 * normal.cdf(z0 + z / (1 - acceleration * z)), 0.1), 99.9))
    return out[0], out[1]
