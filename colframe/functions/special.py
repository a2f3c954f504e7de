"""Special functions and distributions: closed forms as Columns, the others vectorised over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from colframe.shipping import ship

#: Coefficients of Abramowitz and Stegun 7.1.26 (fixed values).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Lanczos coefficients for g = 7, n = 9 (fixed values).
STEP = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _poly(x: Column, coefficients) -> Column:
    """Horner's scheme, lowest coefficient first."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def erf(x: Column) -> Column:
    """Error function within 1.5e-7."""
    t = 1 / (1 + ERF_P * F.abs(x))
    return F.signum(x) * (1 - t * _poly(t, ERF_A) * F.exp(-x * x))


def erfc(x: Column) -> Column:
    return 1 - erf(x)


def expit(x: Column) -> Column:
    """Sigmoid, stable for both signs."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column) -> Column:
    inf = float("inf")
    return F.when(p == 0, F.lit(-inf)).when(p == 1, F.lit(inf)).when((p < 0) | (p > 1), F.lit(float("nan"))).otherwise(F.log(p / (1 - p)))


def ndtr(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def norm_pdf(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    z = (x - loc) / scale
    return F.exp(-z * z / 2) / (scale * math.sqrt(2 * math.pi))


def norm_cdf(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    return ndtr((x - loc) / scale)


def uniform_pdf(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    return F.when((x >= loc) & (x <= loc + scale), 1 / scale).otherwise(0.0)


def uniform_cdf(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    return F.least(F.greatest((x - loc) / scale, F.lit(0.0)), F.lit(1.0))


def uniform_ppf(p: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    return loc + scale * p


def expon_pdf(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    z = (x - loc) / scale
    return F.when(z < 0, 0.0).otherwise(F.exp(-z) / scale)


def expon_cdf(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    z = (x - loc) / scale
    return F.when(z < 0, 0.0).otherwise(1 - F.exp(-z))


def expon_ppf(p: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    return F.when(p >= 1, float("inf")).otherwise(loc - scale * F.log(1 - p))


def laplace_pdf(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    return F.exp(-F.abs((x - loc) / scale)) / (2 * scale)


def laplace_cdf(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    z = (x - loc) / scale
    half = 0.5 * F.exp(-F.abs(z))
    return F.when(z < 0, half).otherwise(1 - half)


def laplace_ppf(p: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    return F.when(p < 0.5, loc + scale * F.log(2 * p)).otherwise(loc - scale * F.log(2 * (1 - p)))


def logistic_pdf(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    s = expit((x - loc) / scale)
    return s * (1 - s) / scale


def logistic_cdf(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    return expit((x - loc) / scale)


def logistic_ppf(p: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    return loc + scale * logit(p)


# --- kernels on arrays

def lgamma_(x: np.ndarray) -> np.ndarray:
    """log |gamma(x)| by Lanczos' approximation, with reflection below 0.5."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        low = x < 0.5
        y = np.where(low, 1 - x, x) - 1
        s = LANCZOS[0] + sum(c / (y + i) for i, c in enumerate(LANCZOS[1:], 1))
        t = y + STEP + 0.5
        out = 0.5 * np.log(2 * np.pi) + (y + 0.5) * np.log(t) - t + np.log(s)
        return np.where(low, np.log(np.pi / np.abs(np.sin(np.pi * x))) - out, out)


def gamma_(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        sign = np.where((x < 0) & (np.floor(x) % 2 != 0), -1.0, 1.0)
        return np.where((x <= 0) & (x == np.floor(x)), np.nan, sign * np.exp(lgamma_(x)))


def gammainc_(a, x, upper: bool = False) -> np.ndarray:
    """Regularised lower (or upper) incomplete gamma: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    low = np.where(np.isnan(x), np.nan, 0.0)
    high = 1 - low
    with np.errstate(all="ignore"):
        small = (x > 0) & (x < a + 1)
        if small.any():
            v, p = x[small], a[small]
            term = total = 1 / p
            for n in range(1, 500):
                term = term * v / (p + n)
                total = total + term
                if (term <= 1e-17 * total).all():
                    break
            low[small] = total * np.exp(-v + p * np.log(v) - lgamma_(p))
            high[small] = 1 - low[small]
        large = x >= a + 1
        if large.any():
            v, p = x[large], a[large]
            b = v + 1 - p
            c, d = np.full(len(v), 1e300), 1 / b
            h = d
            for i in range(1, 300):
                an = -i * (i - p)
                b = b + 2
                d = 1 / (an * d + b)
                c = b + an / c
                h = h * d * c
                if (np.abs(d * c - 1) <= 5e-16).all():
                    break
            high[large] = np.where(np.isinf(v), 0.0, h * np.exp(-v + p * np.log(v) - lgamma_(p)))
            low[large] = 1 - high[large]
    return high if upper else low


def betainc_(a, b, x) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, mirrored where that converges faster."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))

    def fraction(a, b, v):
        tiny = 1e-300
        first = 1 - (a + b) * v / (a + 1)
        c, d = np.ones(len(v)), 1 / np.where(np.abs(first) < tiny, tiny, first)
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * v / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * v / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + top / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if (np.abs(d * c - 1) <= 5e-16).all():
                break
        return h

    out = np.where(np.isnan(x), np.nan, np.where(x >= 1, 1.0, 0.0))
    with np.errstate(all="ignore"):
        direct = (x > 0) & (x < 1) & (x < (a + 1) / (a + b + 2))
        for at, p, q, v in ((direct, a, b, x), ((x > 0) & (x < 1) & ~direct, b, a, 1 - x)):
            p, q, v = p[at], q[at], v[at]
            if len(v):
                part = np.exp(lgamma_(p + q) - lgamma_(p) - lgamma_(q) + p * np.log(v) + q * np.log1p(-v)) * fraction(p, q, v) / p
                out[at] = part if at is direct else 1 - part
    return out


def bessel_i0_(x: np.ndarray) -> np.ndarray:
    """Modified Bessel function of order 0 by its power series."""
    y = (np.asarray(x, float) / 2) ** 2
    term = total = np.ones_like(y)
    for k in range(1, 200):
        term = term * y / k**2
        total = total + term
    return total


def invert(cdf: Callable[[np.ndarray], np.ndarray], p: np.ndarray, low: float, high: float) -> np.ndarray:
    """Quantiles of a distribution between two bounds; high is doubled until it lies above."""
    p = np.asarray(p, float)
    a, b = np.full(len(p), float(low)), np.full(len(p), float(high))
    for _ in range(200):
        below = cdf(b) < p
        if not below.any():
            break
        b = np.where(below, b * 2 + 1, b)
    fa, fb, last = cdf(a) - p, cdf(b) - p, b
    with np.errstate(all="ignore"):
        for _ in range(100):  # Ridders' rule inside a bracket that halves at least
            m = (a + b) / 2
            fm = cdf(m) - p
            x = m + (m - a) * np.sign(fa - fb) * fm / np.sqrt(fm * fm - fa * fb)
            x = np.where((x > a) & (x < b), x, m)
            fx = cdf(x) - p
            for y, fy in ((m, fm), (x, fx)):
                inside, below = (y >= a) & (y <= b), fy < 0
                a, fa = np.where(inside & below, y, a), np.where(inside & below, fy, fa)
                b, fb = np.where(inside & ~below, y, b), np.where(inside & ~below, fy, fb)
            if ((fx == 0) | (np.abs(x - last) <= 2e-15 * np.abs(x))).all():
                return x
            last = x
    return (a + b) / 2


def quantile(cdf: Callable[[np.ndarray], np.ndarray], p: np.ndarray, low: float, high: float) -> np.ndarray:
    """invert() for probabilities; NaN outside 0..1."""
    p = np.asarray(p, float)
    return np.where((p < 0) | (p > 1), np.nan, invert(cdf, p, low, high))


def ndtri_(p: np.ndarray) -> np.ndarray:
    """Normal quantiles by bisection on the exact distribution function of the lower half."""
    p = np.asarray(p, float)
    tail = np.clip(np.minimum(p, 1 - p), 1e-300, 0.5)
    # the smaller the tail, the larger x: 1 - 2 * tail rises with x
    x = invert(lambda v: -0.5 * gammainc_(0.5, v * v / 2, True), -tail, 0, 40) if len(p) else p
    out = np.where(p < 0.5, -x, x)
    return np.where(np.isnan(p), np.nan, np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out)))


def t_cdf_(x: np.ndarray, df: float) -> np.ndarray:
    x = np.asarray(x, float)
    tail = 0.5 * betainc_(df / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - tail, tail)


def _t_ppf(p, df):
    p = np.asarray(p, float)
    upper = quantile(lambda v: t_cdf_(v, df), np.maximum(p, 1 - p), 0, 10)
    return np.where(p < 0.5, -upper, upper)


def _log_binom(n, k):
    return lgamma_(n + 1) - lgamma_(k + 1) - lgamma_(n - k + 1)


KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "gamma": gamma_,
    "gammaln": lgamma_,
    "i0": bessel_i0_,
    "ndtri": ndtri_,
    "norm_ppf": lambda p, loc=0.0, scale=1.0: loc + scale * ndtri_(p),
    "t_pdf": lambda x, df: np.exp(lgamma_((df + 1) / 2) - lgamma_(df / 2)) / np.sqrt(df * np.pi) * (1 + x * x / df) ** (-(df + 1) / 2),
    "t_cdf": t_cdf_,
    "t_ppf": _t_ppf,
    "chi2_pdf": lambda x, df: np.where(x < 0, 0.0, np.exp((df / 2 - 1) * np.log(np.maximum(x, 1e-300)) - x / 2 - df / 2 * np.log(2) - lgamma_(df / 2))),
    "chi2_cdf": lambda x, df: gammainc_(df / 2, np.asarray(x, float) / 2),
    "chi2_ppf": lambda p, df: quantile(lambda v: gammainc_(df / 2, v / 2), p, 0, df + 10),
    "gamma_pdf": lambda x, a: np.where(x < 0, 0.0, np.exp((a - 1) * np.log(np.maximum(x, 1e-300)) - x - lgamma_(a))),
    "gamma_cdf": lambda x, a: gammainc_(a, x),
    "gamma_ppf": lambda p, a: quantile(lambda v: gammainc_(a, v), p, 0, a + 10),
    "beta_pdf": lambda x, a, b: np.where((x < 0) | (x > 1), 0.0, np.exp(lgamma_(a + b) - lgamma_(a) - lgamma_(b) + (a - 1) * np.log(np.clip(x, 1e-300, 1)) + (b - 1) * np.log(np.clip(1 - x, 1e-300, 1)))),
    "beta_cdf": lambda x, a, b: betainc_(a, b, x),
    "beta_ppf": lambda p, a, b: quantile(lambda v: betainc_(a, b, v), p, 0, 1),
    "poisson_pmf": lambda k, mu: np.where((k < 0) | (k != np.floor(k)), 0.0, np.exp(k * np.log(mu) - mu - lgamma_(np.maximum(k, 0) + 1))),
    "poisson_cdf": lambda k, mu: np.where(np.asarray(k) < 0, 0.0, gammainc_(np.floor(np.maximum(k, 0)) + 1, mu, True)),
    "binom_pmf": lambda k, n, p: np.where((k < 0) | (k > n) | (k != np.floor(k)), 0.0, np.exp(_log_binom(n, np.clip(k, 0, n)) + np.clip(k, 0, n) * np.log(p) + (n - np.clip(k, 0, n)) * np.log1p(-p))),
    "binom_cdf": lambda k, n, p: np.where(np.asarray(k) < 0, 0.0, np.where(np.asarray(k) >= n, 1.0, betainc_(n - np.floor(np.clip(k, 0, n - 1)), np.floor(np.clip(k, 0, n - 1)) + 1, 1 - p))),
}


def kernel(name: str, *parameters: float) -> Callable[[Column], Column]:
    """A kernel as a function of a column, computed on Arrow batches; NULL stays NULL."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        v, at = np.unique(x.to_numpy(float), return_inverse=True)  # columns of counts and codes repeat few values
        out = pd.Series(KERNELS[name](v, *parameters)[at])
        return out.where(~x.isna().to_numpy())

    return run
