"""Shared helpers: scratch tables, held-out folds, word rules, hashing of word sequences."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.shipping import ship  # noqa: F401  (re-exported for the operators)
from colframe.sources.scratch import Scratch  # noqa: F401

#: ASCII upper case and its lower case; contracts lower-case only these letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the value's text modulo parts; null for a null value."""
    return F.crc32(F.col(column).cast("string")) % parts


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """The batch in pieces of about ``most`` bytes of a binary or string column (one row at least)."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, in workers that hold nothing of other work.

    Workers live on from task to task, busy or not, and count as their executor's memory. So run begins with tokenizers
    (and the chunks they remember) given up, and at its end freed memory goes back to the system.
    """

    def wrapped(batches):
        if "colframe.llm.bpe" in sys.modules:
            sys.modules["colframe.llm.bpe"].forget()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def elements(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array of ``kind``, and how many elements each has (a null: none)."""
    width = np.dtype(kind).itemsize
    counts = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // width
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind), counts


_P = 0x9E3779B97F4A7C15 | 1
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**j and P**-j modulo 2**64 for j below n at least; both grow by doubling."""
    global _pow, _inv
    while len(_pow) < n:
        k, m = len(_pow), 1 << 64
        _pow = np.concatenate([_pow, _pow * np.uint64(pow(_P, k, m))])
        _inv = np.concatenate([_inv, _inv * np.uint64(pow(pow(_P, -1, m), k, m))])
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that belong to words of the class [^\x20\x09-\x0D]+
SOLID = np.ones(256, bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes that belong to words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[0x41:0x5B] += 0x20


def word_hashes(text: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start byte and end byte of each word; inside tells which (folded) bytes make up words."""
    b = FOLDED[np.frombuffer(text, np.uint8)]
    w = inside[b]
    edge = np.diff(np.concatenate([[False], w, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), start, end
    power, inverse = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)])
        h = (total[end] - total[start]) * inverse[start]
        return mix(h ^ mix((end - start).astype(np.uint64))), start, end


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of k words; for fewer words but not none, one hash of all."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        h = mix(words[: n - k + 1] + np.uint64(k))
        for i in range(1, k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return h
