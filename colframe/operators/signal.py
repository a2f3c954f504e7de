"""Signals: one series per group, transformed by NumPy on the group's ordered samples; windows and kernels as plans."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.shipping import ship


def per_series(df: DataFrame, by: str, order: str, value: str, f: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """f over each series' values in order; f returns columns of equal length, to which the series' key is added.

    A series is a group of its own; its samples have to fit a task.
    """
    ship(df.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(f(g.sort_values(order)[value].to_numpy(float)))
        out.insert(0, by, g[by].iloc[0])
        return out

    kind = dict(df.dtypes)[by]
    return df.select(by, order, value).groupBy(by).applyInPandas(run, f"{by} {kind}, {schema}")


def fft(x: np.ndarray, inverse: bool = False) -> dict:
    y = np.fft.ifft(x) if inverse else np.fft.fft(x)
    return {"k": np.arange(len(y)), "re": y.real, "im": y.imag}


def rfft(x: np.ndarray) -> dict:
    y = np.fft.rfft(x)
    return {"k": np.arange(len(y)), "re": y.real, "im": y.imag}


def irfft_of_rfft(x: np.ndarray) -> dict:
    return {"k": np.arange(len(x)), "x": np.fft.irfft(np.fft.rfft(x), len(x))}


def frequencies(spark: SparkSession, n: int, d: float = 1.0, real: bool = False) -> DataFrame:
    """Bin frequencies of an n-point transform of samples d apart."""
    i = F.col("id")
    signed = i if real else F.when(i < (n + 1) // 2, i).otherwise(i - n)
    return spark.range(n // 2 + 1 if real else n).select(i.alias("k"), (signed / F.lit(n * d)).alias("f"))


def window(spark: SparkSession, kind: str, m: int, sym: bool = True) -> DataFrame:
    """hann, hamming or blackman window of m points; periodic unless sym."""
    if m == 1:
        return spark.range(1).select(F.col("id").alias("k"), F.lit(1.0).alias("w"))
    a = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}[kind]
    t = F.col("id") * (2 * np.pi / (m - 1 if sym else m))
    return spark.range(m).select(F.col("id").alias("k"), (F.lit(a[0]) - a[1] * F.cos(t) + a[2] * F.cos(2 * t)).alias("w"))


def convolve(df: DataFrame, by: str, order: str, value: str, kernel: list[float]) -> DataFrame:
    """Full convolution of each series with a short kernel, as an exploded product summed by position.

    order is the position in the series, from 0; the kernel is part of the plan, so nothing is joined.
    """
    k = F.array(*map(F.lit, map(float, kernel)))
    spread = df.select(by, order, value, F.posexplode(k).alias("_j", "_k"))
    return spread.groupBy(by, (F.col(order) + F.col("_j")).alias("k")).agg(F.sum(F.col(value) * F.col("_k")).alias("y"))


def correlate(df: DataFrame, by: str, order: str, value: str, kernel: list[float]) -> DataFrame:
    return convolve(df, by, order, value, kernel[::-1])


def fftconvolve(x: np.ndarray, kernel: np.ndarray, mode: str = "full") -> np.ndarray:
    n = len(x) + len(kernel) - 1
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(kernel, n), n)
    if mode == "same":
        a = (len(kernel) - 1) // 2
        return y[a : a + len(x)]
    return y[len(kernel) - 1 : len(x)] if mode == "valid" else y


def detrend(df: DataFrame, by: str, order: str, value: str, kind: str = "linear") -> DataFrame:
    """Removes each series' mean (constant) or its least-squares line; two aggregates joined back."""
    t, y = F.col(order).cast("double"), F.col(value)
    if kind == "constant":
        fit = df.groupBy(by).agg(F.lit(0.0).alias("_b"), F.avg(y).alias("_a"))
    else:
        fit = df.groupBy(by).agg(F.coalesce(F.regr_slope(y, t), F.lit(0.0)).alias("_b"), F.coalesce(F.regr_intercept(y, t), F.avg(y)).alias("_a"))
    return df.join(fit, by).withColumn("detrended", y - (F.col("_a") + F.col("_b") * t)).drop("_a", "_b")


def butter(order: int, wn: float, btype: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Butterworth coefficients (b, a) by the bilinear transform; wn is a share of the Nyquist frequency."""
    warped = 4 * np.tan(np.pi * wn / 2)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    poles = warped * poles if btype == "low" else warped / poles
    zeros_z = -np.ones(order) if btype == "low" else np.ones(order)
    poles_z = (4 + poles) / (4 - poles)
    b, a = np.poly(zeros_z).real, np.poly(poles_z).real
    at = 1.0 if btype == "low" else -1.0
    return b * (np.polyval(a, at) / np.polyval(b, at)), a


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, zi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Recursive filter in transposed direct form; returns the output and the final state."""
    n = max(len(a), len(b))
    b, a = np.pad(np.asarray(b, float), (0, n - len(b))) / a[0], np.pad(np.asarray(a, float), (0, n - len(a))) / a[0]
    z = np.zeros(n - 1) if zi is None else np.array(zi, float)
    y = np.empty(len(x))
    for i, v in enumerate(x):
        out = b[0] * v + (z[0] if n > 1 else 0.0)
        if n > 1:
            z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * out
            z[-1] = b[-1] * v - a[-1] * out
        y[i] = out
    return y, z


def lfilter_zi(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State whose response to a constant 1 is steady."""
    n = max(len(a), len(b))
    b, a = np.pad(np.asarray(b, float), (0, n - len(b))) / a[0], np.pad(np.asarray(a, float), (0, n - len(a))) / a[0]
    companion = np.zeros((n - 1, n - 1))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 2)
    return np.linalg.solve(np.eye(n - 1) - companion, b[1:] - a[1:] * b[0])


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filter with odd padding of three filter lengths."""
    edge = min(3 * max(len(a), len(b)), len(x) - 1)
    padded = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]]) if edge > 0 else x
    zi = lfilter_zi(b, a)
    y, _ = lfilter(b, a, padded, zi * padded[0])
    y, _ = lfilter(b, a, y[::-1], zi * y[-1])
    y = y[::-1]
    return y[edge : len(y) - edge] if edge > 0 else y


def _segments(x: np.ndarray, size: int, overlap: int | None) -> np.ndarray:
    step = size - (size // 2 if overlap is None else overlap)
    starts = np.arange(0, len(x) - size + 1, step)
    return np.array([x[s : s + size] for s in starts]).reshape(-1, size)


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def welch(x: np.ndarray, fs: float, size: int, overlap: int | None = None) -> dict:
    """One-sided power density averaged over Hann segments; neither detrended nor padded."""
    w = _hann(size)
    p = np.abs(np.fft.rfft(_segments(x, size, overlap) * w)) ** 2 / (fs * (w**2).sum())
    p[:, 1 : None if size % 2 else -1] *= 2
    return {"f": np.fft.rfftfreq(size, 1 / fs), "p": p.mean(0) if len(p) else np.full(size // 2 + 1, np.nan)}


def stft(x: np.ndarray, fs: float, size: int, overlap: int | None = None) -> dict:
    """Magnitudes (f, segment, m) of Hann segments, scaled by the window's sum."""
    w = _hann(size)
    m = np.abs(np.fft.rfft(_segments(x, size, overlap) * w)) / w.sum()
    f = np.fft.rfftfreq(size, 1 / fs)
    return {"f": np.tile(f, len(m)), "segment": np.repeat(np.arange(len(m)), len(f)), "m": m.ravel()}
