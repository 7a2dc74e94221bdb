"""Student-t tails and quantiles.

Quantiles are column expressions: a table by whole degrees of freedom, and a series in 1/df
beyond it. Tails need the incomplete beta function, which Spark SQL lacks, so they are an
Arrow-batched UDF over the (small) table of test statistics.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_DF = 200


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + lg(b) - lg(a + b)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 120) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated from the tail inwards."""
    acc = np.zeros_like(x)
    for m in range(steps, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        acc = even / (1.0 + odd / (1.0 + acc))
    first = -(a + b) * x / (a + 1)
    return 1.0 / (1.0 + first / (1.0 + acc))


def regularized_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(aa * np.log(xx) + bb * np.log1p(-xx) - _log_beta(aa, bb)) / aa
    value = np.where(xx <= 0, 0.0, front * _beta_fraction(aa, bb, xx))
    return np.where(flip, 1.0 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    return regularized_beta(df / 2.0, np.full(df.shape, 0.5), df / (df + t * t))


@lru_cache(maxsize=16)
def quantile_table(p: float, size: int = TABLE_DF) -> tuple[float, ...]:
    """Upper quantiles for 1..size degrees of freedom, all bisected together."""
    df = np.arange(1, size + 1, dtype=float)
    low, high = np.zeros(size), np.full(size, 1e3)
    for _ in range(64):
        mid = 0.5 * (low + high)
        heavy = t_two_sided(mid, df) > 2.0 * (1.0 - p)
        low, high = np.where(heavy, mid, low), np.where(heavy, high, mid)
    return tuple(float(x) for x in 0.5 * (low + high))


def normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def t_quantile(p: float, df: Column) -> Column:
    """Quantile column for whole degrees of freedom; null below one."""
    z = normal_quantile(p)
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    v = df.cast("double")
    series = F.lit(z) + F.lit(g1) / v + F.lit(g2) / (v * v) + F.lit(g3) / (v * v * v) + F.lit(g4) / (v * v * v * v)
    table = F.array(*[F.lit(x) for x in quantile_table(p)])
    return F.when((df >= 1) & (df <= TABLE_DF), F.get(table, df.cast("int") - 1)).when(df > TABLE_DF, series)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail probability; null in, null out. Degrees of freedom may be fractional."""
    out = pd.Series(np.nan, index=t.index, dtype="float64")
    ok = t.notna() & df.notna() & (df > 0)
    if ok.any():
        out[ok] = t_two_sided(t[ok].to_numpy(float), df[ok].to_numpy(float))
    return out
