"""Dense algebra on a small matrix a row: array columns in C order, computed by NumPy on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from colframe.shipping import ship


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, l, u) with a = p l u and partial pivoting, over a batch at once."""
    n, m = a.shape[1], len(a)
    u, l, order = a.copy(), np.zeros_like(a), np.tile(np.arange(n), (m, 1))
    every = np.arange(m)
    for k in range(n):
        top = k + np.abs(u[:, k:, k]).argmax(1)
        for x in (u, l, order):
            x[every, k], x[every, top] = x[every, top].copy(), x[every, k].copy()
        l[:, k, k] = 1
        pivot = np.where(u[:, k, k] == 0, 1.0, u[:, k, k])
        l[:, k + 1 :, k] = u[:, k + 1 :, k] / pivot[:, None]
        u[:, k + 1 :] -= l[:, k + 1 :, k, None] * u[:, k, None]
    p = np.zeros_like(a)
    p[every[:, None], order, np.arange(n)] = 1
    return p, l, np.triu(u)


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponentials by scaling, a Taylor series and squaring."""
    size = np.abs(a).sum(2).max(initial=0.0)
    s = max(0, int(np.ceil(np.log2(max(size, 1e-300)))) + 4)
    x = a / 2**s
    out = term = np.broadcast_to(np.eye(a.shape[1]), a.shape)
    for k in range(1, 20):
        term = term @ x / k
        out = out + term
    for _ in range(s):
        out = out @ out
    return out


#: Kernels from a batch of square matrices (and right sides) to arrays with a row for each.
KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "det": lambda a: np.linalg.det(a)[:, None],
    "inv": np.linalg.inv,
    "solve": lambda a, b: np.linalg.solve(a, b[..., None])[..., 0],
    "solve_lower": lambda a, b: np.linalg.solve(np.tril(a), b[..., None])[..., 0],
    "solve_upper": lambda a, b: np.linalg.solve(np.triu(a), b[..., None])[..., 0],
    "cholesky": np.linalg.cholesky,
    "eigvalsh": np.linalg.eigvalsh,
    "eigvals": lambda a: (lambda w: np.stack([w.real, w.imag], -1))(np.sort_complex(np.linalg.eigvals(a).astype(complex))),
    "eigh": lambda a: np.linalg.eigh(a)[1],
    "svdvals": lambda a: np.linalg.svd(a, compute_uv=False),
    "qr_q": lambda a: np.linalg.qr(a)[0],
    "qr_r": lambda a: np.linalg.qr(a)[1],
    "lu_p": lambda a: lu(a)[0],
    "lu_l": lambda a: lu(a)[1],
    "lu_u": lambda a: lu(a)[2],
    "expm": expm,
    "fft2_re": lambda a: np.fft.fft2(a).real,
    "fft2_im": lambda a: np.fft.fft2(a).imag,
}


def apply(what: str, shape: tuple[int, int], *columns: Column) -> Column:
    """KERNELS[what] of the matrices in the first column (and vectors in the others) as a flat array; NULL stays NULL."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, *more: pd.Series) -> pd.Series:
        ok = a.notna().to_numpy()
        for x in more:
            ok &= x.notna().to_numpy()
        out: list[np.ndarray | None] = [None] * len(a)
        if ok.any():
            m = np.array(a[ok].tolist(), float).reshape(-1, *shape)
            got = KERNELS[what](m, *(np.array(x[ok].tolist(), float) for x in more))
            for i, row in zip(np.flatnonzero(ok), got.reshape(len(m), -1)):
                out[i] = row
        return pd.Series(out, dtype=object)

    return run(*columns)
