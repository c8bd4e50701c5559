"""Scalar expressions shared by the operators; a missing value is null, never NaN."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def half_even(x: Column) -> Column:
    """Rounded to an integer, halves to the even neighbour; no negative zero."""
    return F.bround(x, 0).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where that is undefined."""
    return F.try_divide(a, b)


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def log2p1(x: Column) -> Column:
    return F.log2(x + 1)


def stars(p: Column) -> Column:
    """Marks of significance at .05, .01, .001 and .0001."""
    return F.when(p < 0.0001, "****").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """2 * P(N > |z|), from the complementary error function."""
    from math import erfc

    return pd.Series([None if v is None or v != v else erfc(abs(v) / 2**0.5) for v in z], dtype="float64")


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal by bisection on the distribution function; p within (0, 1)."""
    from math import erfc

    cdf = np.vectorize(lambda v: 0.5 * erfc(-v / 2**0.5))
    low, high = np.full(np.shape(p), -40.0), np.full(np.shape(p), 40.0)
    for _ in range(80):
        mid = (low + high) / 2
        under = cdf(mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2
