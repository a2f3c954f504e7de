"""Quadrature, differential equations and minimisers for callbacks, and their distributed form over parameter rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from colframe.shipping import ship


def quad(f: Callable[[float], float], a: float, b: float, eps: float = 1e-9, depth: int = 40) -> float:
    """Adaptive Simpson rule."""

    def rule(x0, f0, x2, f2):
        x1 = (x0 + x2) / 2
        f1 = f(x1)
        return x1, f1, (x2 - x0) / 6 * (f0 + 4 * f1 + f2)

    fa, fb = f(a), f(b)
    todo, total = [(a, fa, b, fb, *rule(a, fa, b, fb), eps, depth)], 0.0
    while todo:
        x0, f0, x2, f2, x1, f1, whole, e, left = todo.pop()
        l, r = rule(x0, f0, x1, f1), rule(x1, f1, x2, f2)
        off = l[2] + r[2] - whole
        if left <= 0 or not abs(off) > 15 * e:  # NaN is not refined
            total += l[2] + r[2] + off / 15
        else:
            todo += [(x0, f0, x1, f1, *l, e / 2, left - 1), (x1, f1, x2, f2, *r, e / 2, left - 1)]
    return total


#: Intervals of many integrals that are halved at once.
PANELS = 1 << 15


def quad_many(f: Callable[[np.ndarray, np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray, eps: float = 1e-9, depth: int = 40) -> np.ndarray:
    """The adaptive Simpson rule of quad for many integrals at once: f(x, at) has values at x of the integrands numbered at.

    Each integral is cut into the same intervals as by quad. The newest intervals are halved first and PANELS at a time, so
    what is held doesn't grow with their number.
    """

    def rule(at, x0, f0, x2, f2):
        x1 = (x0 + x2) / 2
        f1 = np.asarray(f(x1, at), float)
        return x1, f1, (x2 - x0) / 6 * (f0 + 4 * f1 + f2)

    a, b = np.asarray(a, float), np.asarray(b, float)
    total, todo = np.zeros(len(a)), []
    for first in range(0, len(a), PANELS):
        at = np.arange(first, min(first + PANELS, len(a)))
        todo.append((at, a[at], b[at], None))
        while todo:
            at, x0, x2, rest = todo.pop()
            if rest is None:
                f0, f2 = np.asarray(f(x0, at), float), np.asarray(f(x2, at), float)
                x1, f1, whole = rule(at, x0, f0, x2, f2)
                e, left = np.full(len(at), eps), depth
            else:
                f0, f2, x1, f1, whole, e, left = rest
            l, r = rule(at, x0, f0, x1, f1), rule(at, x1, f1, x2, f2)
            off = l[2] + r[2] - whole
            split = (np.abs(off) > 15 * e) & (left > 0)
            np.add.at(total, at[~split], (l[2] + r[2] + off / 15)[~split])
            k = np.flatnonzero(split)
            for some in np.split(k, range(PANELS, len(k), PANELS)) if len(k) else ():
                for lo, flo, hi, fhi, half in ((x0, f0, x1, f1, l), (x1, f1, x2, f2, r)):
                    todo.append((at[some], lo[some], hi[some], (flo[some], fhi[some], *(v[some] for v in half), e[some] / 2, left - 1)))
    return total


def dblquad(f: Callable[[float, float], float], a: float, b: float, low: Callable[[float], float], high: Callable[[float], float], eps: float = 1e-8) -> float:
    """Integral over a <= x <= b and low(x) <= y <= high(x) of f(y, x)."""
    return quad(lambda x: quad(lambda y: f(y, x), low(x), high(x), eps), a, b, eps)


#: Butcher tableaus of the embedded pairs: nodes, stages, weights and error weights (fixed values).
TABLEAUS = {
    "rk45": (
        [0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1],
        [[], [1 / 5], [3 / 40, 9 / 40], [44 / 45, -56 / 15, 32 / 9], [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729], [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656], [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84]],
        [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0],
        [71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40],
        5,
    ),
    "rk23": ([0, 1 / 2, 3 / 4, 1], [[], [1 / 2], [0, 3 / 4], [2 / 9, 1 / 3, 4 / 9]], [2 / 9, 1 / 3, 4 / 9, 0], [5 / 72, -1 / 12, -1 / 9, 1 / 8], 3),
}


def solve_ivp(f: Callable[[float, np.ndarray], np.ndarray], span: tuple[float, float], y0, at, rtol: float = 1e-6, atol: float = 1e-9, method: str = "rk45") -> np.ndarray:
    """States (len(at), dim) of y' = f(t, y), with steps that end at the asked times."""
    nodes, stages, weights, errors, order = TABLEAUS[method]
    t, y, out = float(span[0]), np.array(y0, float), []
    h = (span[1] - span[0]) / 100
    for goal in at:
        while t < goal - 1e-14 * max(1, abs(goal)):
            step = min(h, goal - t)
            k: list[np.ndarray] = []
            for c, row in zip(nodes, stages):
                k.append(np.asarray(f(t + c * step, y + step * sum((w * v for w, v in zip(row, k)), np.zeros_like(y))), float))
            new = y + step * sum(w * v for w, v in zip(weights, k))
            off = step * sum(w * v for w, v in zip(errors, k))
            size = np.sqrt(np.mean((off / (atol + rtol * np.maximum(np.abs(y), np.abs(new)))) ** 2))
            if size <= 1:
                t, y = t + step, new
            factor = 5.0 if size == 0 else min(5.0, max(0.2, 0.9 * size ** (-1 / order)))
            h = step * factor if size > 1 or step == h else max(h, step * factor)
        out.append(y.copy())
    return np.array(out)


def _dealt(df: DataFrame) -> DataFrame:
    """Parameters dealt over all cores: they are small, and a file of them is often a single split."""
    ship(df.sparkSession)
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def over_parameters(df: DataFrame, f: Callable[[pd.Series], dict], schema: str) -> DataFrame:
    """f on each row of parameters; each returns columns of equal length."""

    def run(batches):
        for g in batches:
            out = [f(row) for _, row in g.iterrows()]
            if out:
                yield pd.DataFrame({c: np.concatenate([np.asarray(r[c]) for r in out]) for c in out[0]})

    return _dealt(df).mapInPandas(run, schema)


def over_batches(df: DataFrame, f: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """f on batches of parameter rows, for callbacks that take many rows at once; each returns columns of equal length."""

    def run(batches):
        for g in batches:
            if len(g):
                yield pd.DataFrame(f(g))

    return _dealt(df).mapInPandas(run, schema)


def nelder_mead(f: Callable[[np.ndarray], float], x0, steps: int = 400, xtol: float = 1e-8, ftol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Downhill simplex."""
    x0 = np.array(x0, float)
    simplex = [x0] + [x0 + (0.05 * x0[i] if x0[i] else 0.00025) * np.eye(len(x0))[i] for i in range(len(x0))]
    points = sorted(((f(p), tuple(p)) for p in simplex), key=lambda z: z[0])
    for _ in range(steps):
        values, xs = np.array([v for v, _ in points]), np.array([p for _, p in points])
        if np.abs(xs[1:] - xs[0]).max() <= xtol and np.abs(values[1:] - values[0]).max() <= ftol:
            break
        centre = xs[:-1].mean(0)

        def at(c, centre=centre, worst=xs[-1]):
            p = centre + c * (worst - centre)
            return f(p), tuple(p)

        r = at(-1.0)
        if r[0] < values[0]:
            new = min(r, at(-2.0))
        elif r[0] < values[-2]:
            new = r
        else:
            new = at(-0.5) if r[0] < values[-1] else at(0.5)
            if new[0] >= min(r[0], values[-1]):
                points = [points[0]] + [(f(p), tuple(p)) for p in xs[0] + 0.5 * (xs[1:] - xs[0])]
                points.sort(key=lambda z: z[0])
                continue
        points = sorted([*points[:-1], new], key=lambda z: z[0])
    return np.array(points[0][1]), points[0][0]


def lbfgsb(f: Callable, gradient: Callable, x0, bounds, steps: int = 200, memory: int = 8, gtol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Projected L-BFGS with backtracking: variables at a bound that the gradient pushes against stay there."""
    low, high = (np.array([b[i] for b in bounds], float) for i in (0, 1))
    x = np.clip(np.array(x0, float), low, high)
    fx, g = f(x), np.asarray(gradient(x), float)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(np.clip(x - g, low, high) - x).max() <= gtol:
            break
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        q, stack = np.where(free, g, 0.0), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q = q - a * y
            stack.append(a)
        if pairs:
            s, y = pairs[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(stack)):
            q = q + s * (a - (y @ q) / (s @ y))
        step, direction = 1.0, np.where(free, -q, 0.0)
        if direction @ g >= 0:
            direction, pairs = np.where(free, -g, 0.0), []
        for _ in range(50):
            new = np.clip(x + step * direction, low, high)
            fn = f(new)
            if fn <= fx + 1e-4 * (g @ (new - x)):
                break
            step /= 2
        gn = np.asarray(gradient(new), float)
        s, y = new - x, gn - g
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y)]
        if np.abs(s).max() < 1e-15:
            break
        x, fx, g = new, fn, gn
    return x, fx


def least_squares(residuals: Callable, jacobian: Callable, x0, steps: int = 100, tol: float = 1e-12) -> np.ndarray:
    """Levenberg-Marquardt."""
    x, damping = np.array(x0, float), 1e-3
    r = np.asarray(residuals(x), float)
    for _ in range(steps):
        j = np.asarray(jacobian(x), float)
        a, g = j.T @ j, j.T @ r
        if np.abs(g).max() <= tol:
            break
        dx = np.linalg.solve(a + damping * np.diag(np.maximum(np.diag(a), 1e-12)), -g)
        new = np.asarray(residuals(x + dx), float)
        if new @ new < r @ r:
            small = r @ r - new @ new <= tol * (r @ r)
            x, r, damping = x + dx, new, damping / 3
            if small:
                break
        else:
            damping *= 4
            if damping > 1e16:
                break
    return x
