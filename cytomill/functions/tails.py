"""Probability tails on already aggregated rows.

Spark has no erf, beta or gamma built-ins, so these are Arrow-batched pandas UDFs. They are
called on one row per test, never on raw observations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _each(fn, x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return np.array([fn(v) for v in x.ravel()], dtype=float).reshape(x.shape)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def normal_two_sided_np(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2.0))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz evaluation of the incomplete-beta continued fraction, all rows at once.

    It needs about the square root of the larger parameter in rounds; rows that have not settled after four times that are NaN.
    """
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    step = np.zeros_like(x)
    top = float(np.max(np.maximum(a, b), initial=1.0))
    for m in range(1, 200 + int(4 * math.sqrt(top))):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            total = total * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return np.where(np.abs(step - 1.0) < 1e-12, total, np.nan)


def beta_inc_np(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside)
    )
    flip = inside > (a + 1.0) / (a + b + 2.0)
    left = front * _beta_fraction(np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - inside, inside))
    out = np.where(flip, 1.0 - left / b, left / a)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def student_two_sided_np(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    return beta_inc_np(dof / 2.0, np.full_like(dof, 0.5), dof / (dof + t * t))


def hypergeom_upper_np(k: int, total: int, good: int, drawn: int) -> float:
    """P(X >= k) when `drawn` items are taken from `total` of which `good` are marked."""
    def log_choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    top = min(good, drawn)
    if k > top:
        return 0.0
    low = max(drawn - (total - good), 0)
    if k <= low:
        return 1.0
    # terms rise to the mode and fall behind it: sum the side of it that k is on, outwards by the ratio of neighbours
    upper = k > (good + 1) * (drawn + 1) // (total + 2)
    i = k if upper else k - 1
    term = math.exp(log_choose(good, i) + log_choose(total - good, drawn - i) - log_choose(total, drawn))
    terms = [term]
    while (i < top if upper else i > low) and term > 1e-18 * terms[0]:
        if upper:
            term *= (good - i) * (drawn - i) / ((i + 1) * (total - good - drawn + i + 1))
            i += 1
        else:
            term *= i * (total - good - drawn + i) / ((good - i + 1) * (drawn - i + 1))
            i -= 1
        terms.append(term)
    return min(1.0, math.fsum(terms)) if upper else max(0.0, 1.0 - math.fsum(terms))


def _fill(mask: np.ndarray, values: np.ndarray) -> pd.Series:
    out = np.full(len(mask), np.nan)
    out[mask] = values
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """p = P(|Z| >= |z|)."""
    ok = z.notna().to_numpy()
    return _fill(ok, normal_two_sided_np(z.to_numpy(dtype=float)[ok]))


@F.pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    """p = P(Z >= z)."""
    ok = z.notna().to_numpy()
    return _fill(ok, 0.5 * _erfc(z.to_numpy(dtype=float)[ok] / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """p = P(|T_dof| >= |t|)."""
    ok = (t.notna() & dof.notna() & (dof > 0)).to_numpy()
    return _fill(ok, student_two_sided_np(t.to_numpy(dtype=float)[ok], dof.to_numpy(dtype=float)[ok]))


@F.pandas_udf(DoubleType())
def fisher_upper(k: pd.Series, total: pd.Series, good: pd.Series, drawn: pd.Series) -> pd.Series:
    """One-sided (enrichment) exact p of a 2x2 table given as counts and margins."""
    return pd.Series([hypergeom_upper_np(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, total, good, drawn)])


def _signed_rank_exact(w: float, n: int) -> float:
    """Two-sided exact p of the signed-rank statistic min(W+, W-) for n untied differences."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for i in range(1, n + 1):
        ways[i:] = ways[i:] + ways[:-i].copy()
    return min(1.0, 2.0 * ways[: int(math.floor(w)) + 1].sum() / 2.0 ** n)


def signed_rank_p(w: Column, n: Column, tie_term: Column, exact: bool = False) -> Column:
    """Two-sided p: by default normal with tie correction and no continuity term; `exact` counts all sign patterns, which untied
    differences need (tied ones then give NULL) and which takes n squared steps a row."""

    @F.pandas_udf(DoubleType())
    def run(w: pd.Series, n: pd.Series, tie_term: pd.Series) -> pd.Series:
        out = []
        for wi, ni, ti in zip(w, n, tie_term):
            ni = int(ni)
            var = ni * (ni + 1) * (2 * ni + 1) / 24.0 - ti / 48.0
            if ni == 0:
                out.append(1.0)
            elif exact:
                out.append(_signed_rank_exact(wi, ni) if ti == 0 else float("nan"))
            else:
                out.append(math.erfc(abs(wi - ni * (ni + 1) / 4.0) / math.sqrt(var) / math.sqrt(2.0)) if var > 0 else 1.0)
        return pd.Series(out, dtype=float)

    p = run(w, n, tie_term)
    return F.when(~F.isnan(p), p)
