"""Scalar statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def pct(n: Column, d: Column, places: int = 2) -> Column:
    """100 n / d rounded; null where d is 0."""
    return F.when(d > 0, F.round(100.0 * n / d, places))


def wilson(hits: Column, n: Column, z: float = Z95, places: int = 6) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, clamped to [0, 1]; null where n is 0."""
    h, m = hits.cast("double"), n.cast("double")
    p = h / m
    centre = p + z * z / (2 * m)
    half = F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) * z
    base = 1 + z * z / m
    low = F.round(F.greatest(F.lit(0.0), (centre - half) / base), places)
    high = F.round(F.least(F.lit(1.0), (centre + half) / base), places)
    return F.when(m > 0, low), F.when(m > 0, high)


def fisher_exact(a: int, b: int, c: int, d: int) -> dict[str, float]:
    """Odds ratio and exact p-values of a 2x2 table; ties with the table's own weight count with a slack of 1e-15."""
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, col - (n - row)), min(row, col)
    total = math.comb(n, col)
    weight = {k: math.comb(row, k) * math.comb(n - row, col - k) / total for k in range(lo, hi + 1)}
    own = weight[a]
    ratio = math.inf if b * c == 0 and a * d > 0 else (0.0 if b * c == 0 else a * d / (b * c))
    return {
        "odds_ratio": ratio,
        "two_sided": min(1.0, sum(w for w in weight.values() if w <= own + 1e-15)),
        "greater": min(1.0, sum(w for k, w in weight.items() if k >= a)),
        "less": min(1.0, sum(w for k, w in weight.items() if k <= a)),
    }
