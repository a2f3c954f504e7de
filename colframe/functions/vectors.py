"""Vectors held in one cell (ARRAY<DOUBLE>): elementwise maths, reductions, selection, activations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from colframe.functions.cleaning import ieee_divide, ieee_log, round_away, truncate

NAN = float("nan")
#: Elementwise functions of one vector.
UNARY: dict[str, Callable[[Column], Column]] = {
    "sqrt": lambda x: F.when(x < 0, F.lit(NAN)).otherwise(F.sqrt(x)),
    "exp": F.exp,
    "log": ieee_log,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "tanh": F.tanh,
    "negative": lambda x: -x,
    "abs": F.abs,
    "sign": F.signum,
    "square": lambda x: x * x,
    "reciprocal": lambda x: ieee_divide(F.lit(1.0), x),
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "trunc": truncate,
    "round": round_away,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(x * 0.01),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "silu": lambda x: x / (1 + F.exp(-x)),
    "gelu": lambda x: 0.5 * x * (1 + F.tanh(F.lit(0.7978845608028654) * (x + 0.044715 * x * x * x))),
}
#: Elementwise functions of two vectors.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": ieee_divide,
    "power": F.pow,
    "maximum": lambda a, b: F.greatest(a, b),
    "minimum": lambda a, b: F.least(a, b),
    "greater": lambda a, b: (a > b).cast("double"),
    "greater_equal": lambda a, b: (a >= b).cast("double"),
    "less": lambda a, b: (a < b).cast("double"),
    "less_equal": lambda a, b: (a <= b).cast("double"),
    "equal": lambda a, b: (a == b).cast("double"),
    "not_equal": lambda a, b: (a != b).cast("double"),
}


def unary(name: str, v: Column) -> Column:
    f = UNARY[name]
    return F.transform(v, lambda x: f(x))


def binary(name: str, a: Column, b: Column) -> Column:
    """Elementwise function of two vectors of one length; a vector of one element is broadcast by the caller's scalar form."""
    return F.zip_with(a, b, BINARY[name])


def scalar(name: str, a: Column, s: Column) -> Column:
    """Elementwise function with a number broadcast to the vector's length."""
    f = BINARY[name]
    return F.transform(a, lambda x: f(x, s))


def clip(v: Column, low: float, high: float) -> Column:
    return F.transform(v, lambda x: F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def where(condition: Column, x: Column, y: Column) -> Column:
    """x where the condition vector is not 0, else y."""
    return F.transform(F.arrays_zip(condition.alias("c"), x.alias("x"), y.alias("y")), lambda r: F.when(r["c"] != 0, r["x"]).otherwise(r["y"]))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, though f uses it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v))


def var(v: Column) -> Column:
    """Population variance."""
    return let(mean(v), lambda m: F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), F.size(v)))


def std(v: Column) -> Column:
    return F.sqrt(var(v))


def argmin(v: Column) -> Column:
    """Position of the first smallest element, from 0."""
    return F.array_position(v, F.array_min(v)) - 1


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column, order: str = "2") -> Column:
    if order == "1":
        return total(F.transform(v, F.abs))
    if order == "inf":
        return F.array_max(F.transform(v, F.abs))
    return F.sqrt(dot(v, v))


def cumulative(v: Column, what: str = "sum") -> Column:
    """Running sum or product, one pass over the vector."""
    f = {"sum": lambda a, x: a + x, "prod": lambda a, x: a * x}[what]
    start = F.lit(0.0 if what == "sum" else 1.0)
    empty = F.struct(start.alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        now = f(acc["last"], x)
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(v, empty, step, lambda acc: acc["out"])


def softmax(v: Column) -> Column:
    return let(
        F.array_max(v),
        lambda m: let(F.transform(v, lambda x: F.exp(x - m)), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))),
    )


def logsumexp(v: Column) -> Column:
    return let(F.array_max(v), lambda m: m + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - m))))


def log_softmax(v: Column) -> Column:
    return let(logsumexp(v), lambda z: F.transform(v, lambda x: x - z))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    return let(mean(v), lambda m: let(F.sqrt(var(v) + eps), lambda s: F.transform(v, lambda x: (x - m) / s)))


def linear(v: Column, weight: list[list[float]], bias: list[float] | None = None) -> Column:
    """v W^T + b with weight rows per output, as one expression."""
    rows = [dot(v, F.array(*map(F.lit, map(float, w)))) for w in weight]
    return F.array(*[r + float(b) for r, b in zip(rows, bias)] if bias else rows)


def take(v: Column, indices: list[int]) -> Column:
    """Elements at positions from 0; duplicates allowed."""
    return F.transform(F.array(*map(F.lit, indices)), lambda i: F.get(v, i))


def compress(mask: Column, v: Column) -> Column:
    """Elements where the mask is not 0."""
    return F.transform(F.filter(F.arrays_zip(mask.alias("m"), v.alias("v")), lambda r: r["m"] != 0), lambda r: r["v"])


def stride(v: Column, start: int, stop: int, step: int) -> Column:
    """v[start:stop:step] for nonnegative bounds and a positive step."""
    return F.filter(F.slice(v, start + 1, max(0, stop - start)), lambda x, i: i % step == 0)


def pad(v: Column, length: Column, value: float) -> Column:
    """The vector filled up to a length, as a ragged batch becomes dense."""
    return F.concat(v, F.array_repeat(F.lit(float(value)), F.greatest(length - F.size(v), F.lit(0)).cast("int")))


def reshape(v: Column, columns: int) -> Column:
    """Rows of ``columns`` elements (C order)."""
    return F.transform(F.sequence(F.lit(0), (F.size(v) / columns).cast("int") - 1), lambda i: F.slice(v, i * columns + 1, columns))


def concatenate(*v: Column) -> Column:
    return F.concat(*v)


def linspace(start: float, stop: float, n: int) -> Column:
    if n == 1:
        return F.array(F.lit(float(start)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * ((stop - start) / (n - 1)))


def arange(start: float, stop: float, step: float) -> Column:
    n = max(0, -int(-(stop - start) // step))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * float(step)) if n else F.array().cast("array<double>")
