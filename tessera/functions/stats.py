"""Distribution functions and tests on a few numbers; the heavy sums stay in Spark."""

import math
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    p = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return p if t >= 0 else 1 - p


def tost_p(mean_a, mean_b, var_a, var_b, n_a, n_b, margin_sd: float = 0.2):
    """Equivalence p of two one-sided t tests with pooled variance and a margin in pooled standard deviations."""
    if n_a is None or n_b is None or n_a < 2 or n_b < 2:
        return None
    pooled = ((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)
    if pooled <= 0:
        return None
    sd = math.sqrt(pooled)
    se, diff, margin, df = sd * math.sqrt(1 / n_a + 1 / n_b), mean_a - mean_b, margin_sd * sd, n_a + n_b - 2
    return max(t_sf((diff + margin) / se, df), t_sf((margin - diff) / se, df))


@F.pandas_udf(T.DoubleType())
def tost_p_column(ma: pd.Series, mb: pd.Series, va: pd.Series, vb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    return pd.Series([tost_p(*r) for r in zip(ma, mb, va, vb, na, nb, strict=True)], dtype="float64")


def mwu_p(a: list[float], b: list[float]):
    """Two-sided Mann-Whitney p: exact for samples up to 8 without ties, else normal with tie and continuity correction."""
    n, m = len(a), len(b)
    if not n or not m:
        return None
    both = sorted(a + b)
    counts = Counter(both)
    first = {}
    for i, v in enumerate(both):
        first.setdefault(v, i)
    rank = {v: first[v] + (c + 1) / 2 for v, c in counts.items()}
    u = sum(rank[v] for v in a) - n * (n + 1) / 2
    top = max(u, n * m - u)
    if min(n, m) <= 8 and len(counts) == n + m:
        ways = [1] + [0] * (n * m)
        for i in range(1, n + 1):  # Gaussian binomial by multiplying and dividing factors
            for j in range(n * m, m + i - 1, -1):
                ways[j] -= ways[j - m - i]
            for j in range(i, n * m + 1):
                ways[j] += ways[j - i]
        return min(1.0, 2 * sum(ways[math.ceil(top) :]) / sum(ways))
    total = n + m
    ties = sum(c**3 - c for c in counts.values())
    sd = math.sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1)))) if total > 1 else 0
    if not sd:
        return None
    return min(1.0, 2 * normal_sf((top - n * m / 2 - 0.5) / sd))
