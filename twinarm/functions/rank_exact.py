"""Exact two-sided rank-sum p-value for small untied samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_sum_counts(m: int, n: int) -> np.ndarray:
    """Number of arrangements for each value 0..mn of the rank-sum statistic."""
    ways = np.zeros((m + 1, m * n + 1))
    ways[0, 0] = 1.0
    for place in range(m + n):
        for size in range(min(m, place + 1), 0, -1):
            shift = place - (size - 1)
            if shift <= m * n:
                ways[size, shift:] += ways[size - 1, : m * n + 1 - shift]
    return ways[m]


def exact_rank_p(w: float, m: int, n: int) -> float:
    counts = rank_sum_counts(m, n)
    total, w = counts.sum(), int(round(w))
    tail = counts[w:].sum() if w > m * n / 2 else counts[: w + 1].sum()
    return float(min(1.0, 2 * tail / total))


def exact_p(w: str, m: str, n: str, when: Column) -> Column:
    """Exact p where ``when`` holds, NULL elsewhere; both arms are below 50 there."""

    @F.pandas_udf("double")
    def run(w: pd.Series, m: pd.Series, n: pd.Series, use: pd.Series) -> pd.Series:
        return pd.Series(
            [exact_rank_p(a, int(b), int(c)) if u else None for a, b, c, u in zip(w, m, n, use)], dtype=object
        )

    return run(F.col(w), F.col(m), F.col(n), when)
