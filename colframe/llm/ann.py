"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Vectors are quantised to int8 with a scale each; the product of two tiles gives approximate distances, and the norms
of the quantisation residuals bound their error. Only pairs whose lower bound does not exceed the k-th smallest upper
bound of their query are computed in double precision, so the neighbours found are exact. Heaps of k merge them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import Scratch, ship

#: Queries that are searched in one pass over the table, and rows of a tile.
QUERY_BLOCK, TILE = 32768, 4096


def _valid(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v) with a non-null id and a vector of finite components, not all zero."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0.0))


class Quantised:
    """Rows as int8 with a scale each; residual: norm of what quantisation changed; norm: of the quantised rows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        scale = np.abs(x).max(1, keepdims=True) / 127
        self.codes = np.rint(x / scale).astype(np.int8)
        near = self.codes * scale
        self.scale = scale[:, 0]
        self.residual = np.sqrt(((x - near) ** 2).sum(1)) * (1 + 1e-9)
        self.norm = np.sqrt((near**2).sum(1)) * (1 + 1e-9)

    def __getitem__(self, at: slice) -> Quantised:
        out = object.__new__(Quantised)
        for name in ("x", "codes", "scale", "residual", "norm"):
            setattr(out, name, getattr(self, name)[at])
        return out


def bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all pairs of a tile.

    By the triangle inequality a distance differs from that of the quantised vectors by at most both residuals. The
    integer products are exact in float32 up to 1040 components, in float64 beyond.
    """
    kind = np.float32 if q.codes.shape[1] <= 1040 else np.float64
    product = (q.codes.astype(kind) @ c.codes.astype(kind).T).astype(np.float64)
    product *= q.scale[:, None] * c.scale
    square = (q.norm**2)[:, None] + (c.norm**2) - 2 * product
    slack = 1e-7 * ((q.norm**2)[:, None] + c.norm**2)
    off = q.residual[:, None] + c.residual
    low = np.sqrt(np.maximum(square - slack, 0)) - off
    return low, np.sqrt(np.maximum(square + slack, 0)) + off


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed in the order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


class Best:
    """The k nearest found for each query: (score, id), ties to the smaller id; one entry for each id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        self.limit = np.full(n, np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, score, query))
        query, score, ids = query[order], score[order], ids[order]
        names, start = np.unique(query, return_index=True)
        for q, a, b in zip(names, start, [*start[1:], len(query)]):
            own = ids[a:b]
            at = a + np.sort(np.unique(own, return_index=True)[1])[: self.k]  # each id's nearest row
            best: dict[int, float] = {}
            for s, i in sorted([*self.rows[q], *zip(score[at].tolist(), ids[at].tolist())]):
                best.setdefault(i, s)
                if len(best) == self.k:
                    break
            self.rows[q] = [(s, i) for i, s in best.items()]
            if len(best) == self.k:
                self.limit[q] = self.rows[q][-1][0]


def search_tile(queries: Quantised, query_ids: np.ndarray, tile: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Adds a tile's rows to the queries' nearest."""
    c = Quantised(tile)
    for a in range(0, len(query_ids), 512):
        part = slice(a, a + 512)
        low, high = bounds(queries[part], c)
        own = query_ids[part, None] == ids
        low[own] = high[own] = np.inf
        if high.shape[1] > best.k and len(np.unique(ids)) == len(ids):
            limit = np.minimum(best.limit[part], np.partition(high, best.k - 1, axis=1)[:, best.k - 1])
        else:
            limit = best.limit[part]
        q, at = np.nonzero((low <= limit[:, None] * (1 + 1e-12)) & ~own)
        if len(q):
            best.add(q + a, distances(queries.x[a + q], tile[at]), ids[at])


def nearest(spark: SparkSession, queries: DataFrame, table: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of table by Euclidean distance for each row of queries, the query's own id apart.

    Returns query_id, rank (from 1), vec_id and score, nearest first, ties to the smaller vec_id; all candidates if
    there are fewer than k. Vectors that are null, zero or hold null or non-finite components take no part, nor do
    rows with a null id; vectors of different lengths are not compared. Rows that repeat an id count once, with
    the nearest of their vectors. Queries are taken in blocks of about QUERY_BLOCK by a hash of the id. A block is
    searched in one pass over the table, whose tasks keep k rows a query, and its result is saved before the next one is
    read, so driver and tasks hold one block whatever the number of queries.
    """
    ship(spark)
    scratch = Scratch(spark, "nearest")
    queries, table = _valid(queries, id_, vector), _valid(table, id_, vector)
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    if blocks > 1:
        queries = scratch.save(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).sort("block"))
    found = [scratch.save(_search(spark, queries.where(F.col("block") == i).drop("block") if blocks > 1 else queries, table, k)) for i in range(blocks)]
    out = reduce(DataFrame.union, found)
    one = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = one.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _search(spark: SparkSession, block: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's k nearest for each query of the block."""
    got = block.toArrow()  # a block of queries, of bounded size
    by_size: dict[int, tuple[list, list]] = {}
    for i, v in zip(got.column("id").to_pylist(), got.column("v").to_pylist()):
        ids, rows = by_size.setdefault(len(v), ([], []))
        ids.append(i)
        rows.append(v)
    shared = spark.sparkContext.broadcast({d: (np.array(i, np.int64), np.array(r, np.float64)) for d, (i, r) in by_size.items()})

    def run(batches):
        asked = {d: (i, Quantised(x), Best(len(i), k)) for d, (i, x) in shared.value.items()}
        for batch in batches:
            ids, v = batch.column("id").to_numpy(), batch.column("v")
            size = v.value_lengths().to_numpy()
            flat, start = v.values.to_numpy(), v.offsets.to_numpy()[:-1]
            for d in np.unique(size):
                if int(d) not in asked:
                    continue
                names, q, best = asked[int(d)]
                at = np.flatnonzero(size == d)
                for a in range(0, len(at), TILE):
                    some = at[a : a + TILE]
                    search_tile(q, names, flat[start[some][:, None] + np.arange(d)], ids[some], best)
        for names, _, best in asked.values():
            rows = [(int(names[i]), x, s) for i, found in enumerate(best.rows) for s, x in found]
            for a in range(0, len(rows), 50_000):
                q, x, s = zip(*rows[a : a + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return table.mapInArrow(run, "query_id long, vec_id long, score double")
