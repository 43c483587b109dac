"""Tail of Student's t-distribution, vectorised."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _series(x: np.ndarray) -> np.ndarray:
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument above 10."""
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    while (low := x < 10).any():
        shift[low] += np.log(x[low])
        x[low] += 1
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + _series(x) - shift


def _log_gamma_ratio(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(gamma(x + b) / gamma(x)) without the difference of two large numbers."""
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    while (low := x < 10).any():
        shift[low] += np.log1p(b[low] / x[low])
        x[low] += 1
    return (x + b - 0.5) * np.log1p(b / x) + b * np.log(x) - b + _series(x + b) - _series(x) - shift


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in itertools.count(1):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
        # Settled, or no longer a number (which stays one in the result).
        if np.all(~(np.abs(c * d - 1) >= 1e-15)):
            return out


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray | None = None) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b). ``rest`` is 1 - x where it is known better."""
    x = np.clip(x, 0.0, 1.0)
    rest = 1 - x if rest is None else rest
    end = (x <= 0) | (rest <= 0)
    inner, other = np.where(end, 0.5, x), np.where(end, 0.5, rest)
    log_inner = np.where(other < 0.5, np.log1p(-np.minimum(other, 0.5)), np.log(inner))
    front = np.exp(_log_gamma_ratio(a, b) - _log_gamma(b) + a * log_inner + b * np.log(other))
    direct = inner < (a + 1) / (a + b + 2)
    left = front * _beta_fraction(a, b, np.where(direct, inner, 0.5)) / a
    right = 1 - front * _beta_fraction(b, a, np.where(direct, 0.5, other)) / b
    return np.where(x <= 0, 0.0, np.where(rest <= 0, 1.0, np.where(direct, left, right)))


def t_tail(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for the given degrees of freedom."""
    t, freedom = np.asarray(t, dtype=float), np.asarray(freedom, dtype=float)
    square = t * t
    return beta_share(freedom / 2, np.full_like(freedom, 0.5), freedom / (freedom + square), square / (freedom + square))


def two_sided_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of a t statistic; null stays null."""

    @F.pandas_udf("double")
    def tail(t_values: pd.Series, freedom_values: pd.Series) -> pd.Series:
        known = t_values.notna() & (freedom_values > 0)
        out = pd.Series(np.nan, index=t_values.index, dtype="float64")
        if known.any():
            out[known] = t_tail(t_values[known].to_numpy(), freedom_values[known].to_numpy())
        return out.astype(object).where(out.notna(), None)

    return tail(t, freedom)
