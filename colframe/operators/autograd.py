"""Reverse-mode differentiation on a tape of NumPy arrays, and gradients of sums over tables by it."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colframe.shipping import ship

_recording = [True]


@contextmanager
def no_grad():
    """Nothing is recorded inside."""
    was, _recording[0] = _recording[0], False
    try:
        yield
    finally:
        _recording[0] = was


def is_grad_enabled() -> bool:
    return _recording[0]


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over the axes along which its operand was broadcast."""
    g = g.sum(tuple(range(g.ndim - len(shape)))) if g.ndim > len(shape) else g
    wide = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1)
    return g.sum(wide, keepdims=True) if wide else g


class Tensor:
    """A value, and how gradients go from it to what it was made of."""

    def __init__(self, value, requires_grad: bool = False, parents: tuple = ()):
        self.value, self.grad = np.asarray(value, float), None
        self.parents = parents if _recording[0] else ()
        self.requires_grad = requires_grad or any(p.requires_grad for p, _ in self.parents)

    @staticmethod
    def of(x) -> Tensor:
        return x if isinstance(x, Tensor) else Tensor(x)

    def _both(self, other, value, left, right) -> Tensor:
        other = Tensor.of(other)
        a, b = self.value, other.value
        return Tensor(value(a, b), False, ((self, lambda g: _fit(left(g, a, b), a.shape)), (other, lambda g: _fit(right(g, a, b), b.shape))))

    def __add__(self, other):
        return self._both(other, np.add, lambda g, a, b: g, lambda g, a, b: g)

    def __sub__(self, other):
        return self._both(other, np.subtract, lambda g, a, b: g, lambda g, a, b: -g)

    def __mul__(self, other):
        return self._both(other, np.multiply, lambda g, a, b: g * b, lambda g, a, b: g * a)

    def __truediv__(self, other):
        return self._both(other, np.divide, lambda g, a, b: g / b, lambda g, a, b: -g * a / (b * b))

    def __matmul__(self, other):
        return self._both(other, np.matmul, lambda g, a, b: g @ np.swapaxes(b, -1, -2), lambda g, a, b: np.swapaxes(a, -1, -2) @ g)

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self):
        return self * -1.0

    def map(self, f: Callable, slope: Callable) -> Tensor:
        """An elementwise function; slope gets the value and the result."""
        y = f(self.value)
        return Tensor(y, False, ((self, lambda g: g * slope(self.value, y)),))

    def exp(self):
        return self.map(np.exp, lambda x, y: y)

    def log(self):
        return self.map(np.log, lambda x, y: 1 / x)

    def sqrt(self):
        return self.map(np.sqrt, lambda x, y: 0.5 / y)

    def tanh(self):
        return self.map(np.tanh, lambda x, y: 1 - y * y)

    def relu(self):
        return self.map(lambda x: np.maximum(x, 0), lambda x, y: (x > 0).astype(float))

    def sigmoid(self):
        return self.map(lambda x: 1 / (1 + np.exp(-x)), lambda x, y: y * (1 - y))

    def sum(self):
        return Tensor(self.value.sum(), False, ((self, lambda g: np.broadcast_to(g, self.value.shape)),))

    def mean(self):
        return self.sum() * (1.0 / self.value.size)

    def reshape(self, *shape):
        return Tensor(self.value.reshape(shape), False, ((self, lambda g: g.reshape(self.value.shape)),))

    def transpose(self, a: int = -1, b: int = -2):
        return Tensor(np.swapaxes(self.value, a, b), False, ((self, lambda g: np.swapaxes(g, a, b)),))

    def __getitem__(self, at):
        def back(g):
            out = np.zeros_like(self.value)
            np.add.at(out, at, g)
            return out

        return Tensor(self.value[at], False, ((self, back),))

    def order(self) -> list[Tensor]:
        """All tensors this one was made of, each before those made of it."""
        out, seen, todo = [], set(), [(self, False)]
        while todo:
            t, done = todo.pop()
            if done:
                out.append(t)
            elif id(t) not in seen:
                seen.add(id(t))
                todo += [(t, True), *((p, False) for p, _ in t.parents)]
        return out

    def backward(self, g=None) -> None:
        """Adds the gradient of this value (times g) to every tensor that asked for it."""
        grads = {id(self): np.ones_like(self.value) if g is None else np.asarray(g, float)}
        for t in reversed(self.order()):
            own = grads.pop(id(t), None)
            if own is None:
                continue
            if t.requires_grad and not t.parents:
                t.grad = own if t.grad is None else t.grad + own
            for p, f in t.parents:
                if p.requires_grad:
                    grads[id(p)] = grads.get(id(p), 0.0) + f(own)


def apply_function(forward: Callable, backward: Callable, *inputs: Tensor) -> Tensor:
    """A function of one's own: forward(saved, *values), and backward(saved, g), which gives a gradient for each input."""
    saved: list = []
    y = forward(saved, *(x.value for x in inputs))
    return Tensor(y, False, tuple((x, lambda g, i=i: np.asarray(backward(saved, g)[i], float)) for i, x in enumerate(inputs)))


def grad(output: Tensor, inputs: list[Tensor]) -> list[np.ndarray]:
    """Gradients of an output by some tensors, whose own stay as they were."""
    held = [x.grad for x in inputs]
    for x in inputs:
        x.grad = None
    output.backward()
    out = [np.zeros_like(x.value) if x.grad is None else x.grad for x in inputs]
    for x, g in zip(inputs, held):
        x.grad = g
    return out


def gradcheck(f: Callable[..., Tensor], *values: np.ndarray, eps: float = 1e-6) -> float:
    """Largest difference between the tape's gradient of f and central differences."""
    inputs = [Tensor(v, True) for v in values]
    worst = 0.0
    for got, v in zip(grad(f(*inputs), inputs), values):
        for at in np.ndindex(np.shape(v)):
            moved = []
            for step in (eps, -eps):
                w = [np.array(x, float) for x in values]
                w[next(i for i, x in enumerate(values) if x is v)][at] += step
                moved.append(float(f(*map(Tensor, w)).value))
            worst = max(worst, abs(got[at] - (moved[0] - moved[1]) / (2 * eps)))
    return worst


def gradient(df: DataFrame, columns: list[str], f: Callable[..., Tensor], parameters: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """Sum of f over the rows of a table, and its gradient by the parameters.

    f(batch, *parameters) gets the columns as arrays, a row each, and gives the sum over its rows. Tasks send one row
    of sums, however many rows of the table they have.
    """
    ship(df.sparkSession)
    shapes, sizes = [np.shape(p) for p in parameters], np.cumsum([np.size(p) for p in parameters])

    def run(batches):
        total, sums = 0.0, np.zeros(int(sizes[-1]))
        for b in batches:
            if len(b):
                inputs = [Tensor(p, True) for p in parameters]
                loss = f([np.array(b.column(c).to_pylist(), float) for c in columns], *inputs)
                loss.backward()
                total += float(loss.value)
                sums += np.concatenate([(np.zeros(np.shape(p)) if x.grad is None else x.grad).ravel() for x, p in zip(inputs, parameters)])
        yield pa.RecordBatch.from_arrays([pa.array([[total, *sums]], pa.list_(pa.float64()))], ["g"])

    rows = df.select(*columns).mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(int(sizes[-1]) + 1)
    for r in rows:  # a row a parameter
        out[r["at"]] = r["v"]
    return float(out[0]), [x.reshape(s) for x, s in zip(np.split(out[1:], sizes[:-1]), shapes)]
