"""Arrays of any number of axes as flat array columns in C order, their shapes known when the plan is built.

An operation that only moves elements is a list of source positions, computed once in NumPy and put into the plan as
one gather expression, so rows stay in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from colframe.functions.vectors import take

Shape = tuple[int, ...]


def _places(shape: Shape) -> np.ndarray:
    return np.arange(int(np.prod(shape, dtype=int))).reshape(shape)


def _gather(v: Column, places: np.ndarray) -> tuple[Column, Shape]:
    return take(v, places.ravel().tolist()), places.shape


def resolve(size: int, shape: Shape) -> Shape:
    """A shape whose one -1 is inferred; raises ValueError if the size doesn't fit."""
    return np.empty(size, np.int8).reshape(shape).shape


def reshape(v: Column, shape: Shape, new: Shape) -> tuple[Column, Shape]:
    return v, resolve(int(np.prod(shape, dtype=int)), new)


def moveaxis(v: Column, shape: Shape, source: int, destination: int) -> tuple[Column, Shape]:
    return _gather(v, np.moveaxis(_places(shape), source, destination))


def swapaxes(v: Column, shape: Shape, a: int, b: int) -> tuple[Column, Shape]:
    return _gather(v, np.swapaxes(_places(shape), a, b))


def permute(v: Column, shape: Shape, order: tuple[int, ...]) -> tuple[Column, Shape]:
    return _gather(v, _places(shape).transpose(order))


def expand_dims(v: Column, shape: Shape, axis: int) -> tuple[Column, Shape]:
    return v, np.expand_dims(_places(shape), axis).shape


def squeeze(v: Column, shape: Shape, axis: int | None = None) -> tuple[Column, Shape]:
    return v, np.squeeze(_places(shape), axis).shape


def index_axis(v: Column, shape: Shape, axis: int, index: int) -> tuple[Column, Shape]:
    """The part at one index of an axis, which goes."""
    return _gather(v, np.take(_places(shape), index, axis))


def slice_axes(v: Column, shape: Shape, slices: list[slice]) -> tuple[Column, Shape]:
    """Python slices, one an axis from the first on; the others stay whole."""
    return _gather(v, _places(shape)[tuple(slices)])


def broadcast_to(v: Column, shape: Shape, new: Shape) -> tuple[Column, Shape]:
    return _gather(v, np.broadcast_to(_places(shape), new))


def stack(arrays: list[Column], shape: Shape, axis: int) -> tuple[Column, Shape]:
    """Arrays of one shape along a new axis."""
    size = int(np.prod(shape, dtype=int))
    return _gather(F.concat(*arrays), np.stack([_places(shape) + i * size for i in range(len(arrays))], axis))


def concatenate(arrays: list[Column], shapes: list[Shape], axis: int) -> tuple[Column, Shape]:
    ends = np.cumsum([0, *(int(np.prod(s, dtype=int)) for s in shapes)])
    return _gather(F.concat(*arrays), np.concatenate([_places(s) + e for s, e in zip(shapes, ends)], axis))


def fancy_index_2d(v: Column, shape: Shape, rows: list[int], columns: list[int]) -> Column:
    """Elements at (rows[i], columns[i])."""
    if len(rows) != len(columns) or len(shape) != 2:
        raise ValueError("rows and columns of a matrix have to pair up")
    return take(v, _places(shape)[rows, columns].tolist())


def take_along_axis(v: Column, shape: Shape, index: Column, length: int, axis: int) -> tuple[Column, Shape]:
    """Elements whose place on an axis is given by ``index``, an array column of v's shape but ``length`` on that axis."""
    out = (*shape[:axis], length, *shape[axis + 1 :])
    stride = int(np.prod(shape[axis + 1 :], dtype=int))
    where = np.indices(out)
    where[axis] = 0
    base = np.ravel_multi_index(tuple(where), shape).ravel().tolist()
    pairs = F.arrays_zip(F.array(*map(F.lit, base)).alias("b"), index.alias("i"))
    return F.transform(pairs, lambda r: F.get(v, (r["b"] + r["i"] * stride).cast("int"))), out


def bmm(a: Column, b: Column, batch: int, rows: int, inner: int, columns: int) -> Column:
    """Products of a batch of matrices (batch, rows, inner) and (batch, inner, columns)."""

    def cell(c):
        n, i, j = F.floor(c / (rows * columns)), F.floor(c / columns) % rows, c % columns
        term = lambda k: F.get(a, ((n * rows + i) * inner + k).cast("int")) * F.get(b, ((n * inner + k) * columns + j).cast("int"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(inner - 1)), F.lit(0.0), lambda s, k: s + term(k))

    return F.transform(F.sequence(F.lit(0), F.lit(batch * rows * columns - 1)), cell)


def astype(v: Column, kind: str) -> Column:
    """Elements as float, double, int (towards zero), long or boolean (not 0)."""
    if kind == "boolean":
        return F.transform(v, lambda x: x != 0)
    return F.transform(v, lambda x: (F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)) if kind in ("int", "long") else x).cast(kind))


def same_bits(a: Column, b: Column) -> Column:
    """Equality of doubles by their bits: NaN equals NaN, 0.0 and -0.0 differ."""
    return (a == b) & ((a != 0) | (a.cast("string") == b.cast("string")))
