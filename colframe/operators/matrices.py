"""Matrices as relations (i, j, v): products, sums, norms; small dense systems are reduced by Spark and solved once.

A sparse matrix is the relation of its nonzero cells, so sparse and dense operations are the same joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from colframe.shipping import ship


def from_vectors(df: DataFrame, row: str, vector: str) -> DataFrame:
    """Rows of vectors as cells."""
    return df.select(F.col(row).alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def to_vectors(m: DataFrame, columns: int) -> DataFrame:
    """Cells as dense rows (i, v)."""
    cells = m.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    return cells.select("i", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.coalesce(F.try_element_at("m", j.cast("bigint")), F.lit(0.0))).alias("v"))


def sparse(m: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Cells of at least the threshold's size that are not 0."""
    return m.where((F.col("v") != 0) & (F.abs("v") >= threshold))


def eye(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def diags(df: DataFrame, index: str, value: str) -> DataFrame:
    return df.select(F.col(index).alias("i"), F.col(index).alias("j"), F.col(value).cast("double").alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scale(m: DataFrame, by: float) -> DataFrame:
    return m.select("i", "j", (F.col("v") * by).alias("v"))


def add(*m: DataFrame) -> DataFrame:
    out = m[0]
    for x in m[1:]:
        out = out.unionByName(x)
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


#: Side of a tile of a large product; products of fewer pairs of cells, or of sparse relations, are joins.
SIDE, FEW = 1024, 1 << 24
#: Cells of a batch that leaves a task, and pairs that are expanded at once.
ROWS, PAIRS = 1 << 16, 1 << 20


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product, with a cell wherever an inner index is in both; pairs of cells are counted first.

    Few pairs are one join on the inner index. Many of them are multiplied tile by tile in NumPy: each index is hashed
    into tiles of about SIDE, an operand's tile goes to every tile of the product that it takes part in, and only the
    products of a task's tiles leave it. They are summed by cell if the inner index has several tiles.
    """
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).where("k IS NOT NULL"), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")).where("k IS NOT NULL")
    count = F.count("*").cast("double")
    both = left.groupBy("k").agg(count.alias("p")).join(right.groupBy("k").agg(count.alias("q")), "k", "full")
    both = both.agg(F.sum(F.col("p") * F.col("q")).alias("pairs"), F.sum("p").alias("p"), F.sum("q").alias("q"), F.count("*").alias("k"))
    sides = left.agg(F.approx_count_distinct("i").alias("i")).join(right.agg(F.approx_count_distinct("j").alias("j")))  # one row each
    n = both.join(sides).first()
    i, j, k = (max(1, -(-n[c] // SIDE)) for c in "ijk")
    if (n["pairs"] or 0) <= max(FEW, 4 * ((n["p"] or 0) * j + (n["q"] or 0) * i)):
        return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    out = _tiled(left, right, i, j, k)
    return out if k == 1 else out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _tiled(left: DataFrame, right: DataFrame, ni: int, nj: int, nk: int) -> DataFrame:
    """Products (i, j, v) of (i, k, x) and (k, j, y), one for each tile of the inner index with pairs for the cell."""
    ship(left.sparkSession)
    inner = left.select("k").unionByName(right.select("k")).schema["k"].dataType  # of both, as a join compares them
    kinds = {"i": left.schema["i"].dataType, "j": right.schema["j"].dataType, "k": inner, "v": DoubleType()}
    tile = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    keys = [StructField(c, IntegerType()) for c in ("ti", "tj", "tk", "side")]

    def packed(m, side, own, v):
        k = F.col("k").cast(inner)
        m = m.select(tile(F.col(own), ni if own == "i" else nj).alias("at"), tile(k, nk).alias("tk"), own, k.alias("k"), F.col(v).cast("double").alias("v")).sortWithinPartitions("at", "tk")
        schema = StructType([StructField("at", IntegerType()), StructField("tk", IntegerType()), *[StructField(c, ArrayType(kinds[c])) for c in (own, "k", "v")]])
        m = m.mapInArrow(_pack, schema)
        other = F.explode(F.sequence(F.lit(0), F.lit((nj if own == "i" else ni) - 1)))
        ti, tj = (F.col("at"), other) if own == "i" else (other, F.col("at"))
        lists = [F.col(c) if c in (own, "k", "v") else F.lit(None).cast(ArrayType(kinds[c])).alias(c) for c in kinds]
        return m.select(ti.alias("ti"), tj.alias("tj"), "tk", F.lit(side).alias("side"), *lists)

    tiles = packed(left, 0, "i", "x").unionByName(packed(right, 1, "j", "y"))
    tiles = tiles.repartition(min(ni * nj * nk, 4096), "ti", "tj", "tk").sortWithinPartitions(*[f.name for f in keys])
    return tiles.mapInArrow(_multiply, StructType([StructField("i", kinds["i"]), StructField("j", kinds["j"]), StructField("v", DoubleType())]))


def _pack(batches):
    """Runs of cells of one tile as one row of lists."""
    for b in batches:
        if not b.num_rows:
            continue
        at, tk = (b.column(c).to_numpy() for c in (0, 1))
        starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (tk[1:] != tk[:-1])])
        offsets = pa.array(np.r_[starts, len(at)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, b.column(c)) for c in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays([pa.array(at[starts]), pa.array(tk[starts]), *lists], b.schema.names)


def _multiply(batches):
    """Products of tiles; all rows of a pair of tiles follow each other, those of the left one first."""
    key, held = None, ([], [])
    for b in batches:
        names = b.schema.names
        at, side = list(zip(*(b.column(c).to_pylist() for c in names[:3]))), b.column("side").to_pylist()
        for r in range(b.num_rows):
            if at[r] != key:
                yield from _product(*held)
                key, held = at[r], ([], [])
            held[side[r]].append([b.column(c)[r].values for c in ("ij"[side[r]], "k", "v")])
    yield from _product(*held)


def _product(left, right):
    """Cells of one product of tiles, given as packets (outer index, inner index, value)."""
    if not left or not right:
        return
    (i, ka, x), (j, kb, y) = ([pa.concat_arrays(c) for c in zip(*side)] for side in (left, right))
    i, j = i.dictionary_encode("encode"), j.dictionary_encode("encode")
    k = pa.concat_arrays([ka, kb]).dictionary_encode()
    ci, cj, ck = (c.indices.to_numpy().astype(np.int64) for c in (i, j, k))
    ni, nj, nk, ca, cb = len(i.dictionary), len(j.dictionary), len(k.dictionary), ck[: len(ka)], ck[len(ka) :]
    x, y = (c.to_numpy(zero_copy_only=False) for c in (x, y))
    okx, oky = (~np.asarray(c.is_null()) for c in (pa.concat_arrays([p[2] for p in left]), pa.concat_arrays([p[2] for p in right])))
    there = [np.bincount(c, minlength=n).reshape(s) for c, n, s in ((ci * nk + ca, ni * nk, (ni, nk)), (cb * nj + cj, nk * nj, (nk, nj)))]
    full = all(t.all() for t in there)
    valued = okx.all() and oky.all()
    pairs = int(np.bincount(ca, minlength=nk) @ np.bincount(cb, minlength=nk))
    # an absent cell must not meet an infinite one as 0
    if pairs * 64 >= ni * nj * nk and ((full and valued) or (np.isfinite(x[okx]).all() and np.isfinite(y[oky]).all())):
        dense = lambda c, v, n, s: np.bincount(c, v, minlength=n).reshape(s)
        v = dense((ci * nk + ca)[okx], x[okx], ni * nk, (ni, nk)) @ dense((cb * nj + cj)[oky], y[oky], nk * nj, (nk, nj))
        seen = None if full else (there[0] > 0).astype(np.float32) @ (there[1] > 0).astype(np.float32)
        known = None if valued else dense((ci * nk + ca)[okx], None, ni * nk, (ni, nk)).astype(float) @ dense((cb * nj + cj)[oky], None, nk * nj, (nk, nj))
    else:
        v, seen, known = np.zeros(ni * nj), np.zeros(ni * nj, np.int64), np.zeros(ni * nj, np.int64)
        order = np.argsort(cb, kind="stable")
        size = np.bincount(cb, minlength=nk)
        first, times = (np.cumsum(size) - size)[ca], size[ca]
        ends = np.cumsum(times)
        a = 0
        while a < len(ca):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            own = np.repeat(np.arange(a, z), times[a:z])
            other = order[np.arange(len(own)) - np.repeat(ends[a:z] - times[a:z] - (ends[a - 1] if a else 0), times[a:z]) + first[own]]
            cell, ok = ci[own] * nj + cj[other], okx[own] & oky[other]
            seen += np.bincount(cell, minlength=ni * nj)
            known += np.bincount(cell[ok], minlength=ni * nj)
            v += np.bincount(cell[ok], x[own[ok]] * y[other[ok]], minlength=ni * nj)
            a = z
    v = v.ravel()
    cells = np.arange(ni * nj) if seen is None else np.flatnonzero(seen.ravel())
    for a in range(0, len(cells), ROWS):
        c = cells[a : a + ROWS]
        null = None if known is None else known.ravel()[c] == 0
        yield pa.RecordBatch.from_arrays([i.dictionary.take(pa.array(c // nj)), j.dictionary.take(pa.array(c % nj)), pa.array(v[c], mask=null)], ["i", "j", "v"])


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """Product with a vector (i, v)."""
    return a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(x.select(F.col("i").alias("k"), F.col("v").alias("y")), "k").groupBy("i").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def trace(m: DataFrame) -> DataFrame:
    return m.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def norm(m: DataFrame, order: str = "fro") -> DataFrame:
    """Frobenius norm, largest column sum (1), largest row sum (inf) or largest singular value (2)."""
    if order == "fro":
        return m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    if order in ("1", "inf"):
        return m.groupBy("j" if order == "1" else "i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm"))
    g = dense(gram(m))
    return m.sparkSession.createDataFrame([(float(np.sqrt(np.linalg.eigvalsh(g)[-1])),)], "norm double")


def reduce_axis(m: DataFrame, axis: int, what: str) -> DataFrame:
    """sum, mean, min or max along an axis (0: over rows, giving one value a column)."""
    return m.groupBy("j" if axis == 0 else "i").agg({"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[what]("v").alias("v"))


def gram(m: DataFrame) -> DataFrame:
    """m^T m, from a self-join on rows."""
    return matmul(transpose(m), m)


#: Largest side of a matrix that is brought to the driver.
LIMIT = 4096


def dense(m: DataFrame) -> np.ndarray:
    """A small matrix on the driver; its size is checked first."""
    rows, columns = m.agg(F.max("i"), F.max("j")).first()
    if rows is None:
        return np.zeros((0, 0))
    if max(rows, columns) >= LIMIT:
        raise ValueError(f"a matrix of {rows + 1} x {columns + 1} is too large for a dense kernel")
    got, out = m.toArrow(), np.zeros((rows + 1, columns + 1))
    out[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("v").to_numpy()
    return out


def cells(spark: SparkSession, a: np.ndarray) -> DataFrame:
    i, j = np.indices(a.shape)
    return spark.createDataFrame(pa.table({"i": i.ravel().astype(np.int64), "j": j.ravel().astype(np.int64), "v": a.ravel().astype(float)}))


def block_sums(df: DataFrame, features: str, target: str | None = None) -> tuple[np.ndarray, np.ndarray | None, int]:
    """X^T X of the rows in an array column, X^T y if there is a target, and the number of rows.

    Each partition multiplies its batches in NumPy and sends one block of d^2 sums, however many rows it has.
    """
    ship(df.sparkSession)

    def partial(batches):
        xtx = xty = None
        n = 0
        for batch in batches:
            v = batch.column(0)
            if not len(v):
                continue
            x = np.array(v.flatten().to_numpy(zero_copy_only=False), float).reshape(len(v), -1)
            y = np.array(batch.column(1).to_numpy(zero_copy_only=False), float) if target else np.zeros(len(x))
            xtx = x.T @ x + (0 if xtx is None else xtx)
            xty = x.T @ y + (0 if xty is None else xty)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[*xtx.ravel(), *xty]], pa.list_(pa.float64()))], ["n", "m"])

    columns = [F.col(features).cast("array<double>"), *([F.col(target).cast("double")] if target else [])]
    parts = df.select(*columns).mapInArrow(partial, "n long, m array<double>")
    total = parts.select("n", F.posexplode("m").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("at").collect()
    flat, n = np.array([r.v for r in total]), total[0].n if total else 0
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2 + 0.5)
    return flat[: d * d].reshape(d, d), flat[d * d :] if target else None, n


def normal_equations(df: DataFrame, features: str, target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X^T X and X^T y with a leading column of ones."""
    one = F.concat(F.array(F.lit(1.0)), F.col(features).cast("array<double>"))
    return block_sums(df.select(one.alias("x"), F.col(target).alias("y")), "x", "y")


def lstsq(df: DataFrame, features: str, target: str) -> np.ndarray:
    """Least-squares coefficients (intercept first)."""
    xtx, xty, _ = normal_equations(df, features, target)
    return np.linalg.lstsq(xtx, xty, rcond=None)[0]


def tall_qr(df: DataFrame, row: str, vector: str) -> tuple[DataFrame, np.ndarray]:
    """Thin QR of the matrix whose rows are vectors: R by Cholesky of the summed Gram blocks, Q's rows beside each row.

    Q is (row, array); a row of Q is its row of A times R^-1, one expression, so nothing is shuffled but the blocks.
    """
    r = np.linalg.cholesky(block_sums(df, vector)[0]).T
    columns = F.array(*[F.array(*map(F.lit, c)) for c in np.linalg.inv(r).T.tolist()])
    x = F.col(vector).cast("array<double>")
    q = F.transform(columns, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return df.select(row, q.alias("q")), r


def singular_values(df: DataFrame, vector: str) -> np.ndarray:
    """Singular values of the matrix whose rows are vectors, from its summed Gram blocks."""
    return np.sqrt(np.maximum(np.linalg.eigvalsh(block_sums(df, vector)[0])[::-1], 0))


def spsolve(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, v) that solves a x = b for a square relation of up to LIMIT rows, whose size is checked before it is fetched."""
    m = dense(a)
    rows = b.where(F.col("i") < len(m)).collect()
    y = np.zeros(len(m))
    for r in rows:
        y[r["i"]] = r["v"]
    x = np.linalg.solve(m, y)
    return a.sparkSession.createDataFrame(pa.table({"i": np.arange(len(x)), "v": x}))


def factor(a: np.ndarray, what: str, b: np.ndarray | None = None):
    """Dense factorisations of small matrices: lu, cholesky, qr, svd, eig, eigh, solve, inv, det, expm, triangular."""
    a = np.asarray(a, float)
    if what == "lu":
        p, l, u = np.eye(len(a)), np.zeros_like(a), a.copy()
        for k in range(len(a)):
            top = k + int(np.abs(u[k:, k]).argmax())
            for x in (p, l, u):
                x[[k, top]] = x[[top, k]]
            l[k, k] = 1
            if u[k, k]:
                l[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
                u[k + 1 :] -= np.outer(l[k + 1 :, k], u[k])
        return p.T, l, np.triu(u)
    if what == "expm":
        s = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 4)
        x, out, term = a / 2**s, np.eye(len(a)), np.eye(len(a))
        for k in range(1, 20):
            term = term @ x / k
            out = out + term
        for _ in range(s):
            out = out @ out
        return out
    if what == "triangular":
        return np.linalg.solve(np.tril(a), b)
    f = {"cholesky": np.linalg.cholesky, "qr": np.linalg.qr, "svd": lambda x: np.linalg.svd(x, full_matrices=False), "eig": np.linalg.eig, "eigh": np.linalg.eigh, "inv": np.linalg.inv, "det": np.linalg.det}
    return np.linalg.solve(a, b) if what == "solve" else f[what](a)


def conjugate_gradient(a: DataFrame, b: DataFrame, tol: float = 1e-10, steps: int = 100) -> DataFrame:
    """Solves a x = b for a sparse positive definite matrix; each step is one distributed product.

    The vectors are relations that are checkpointed in the shared folder at each step, so lineage stays short.
    """
    x = b.select("i", F.lit(0.0).alias("v"))
    r = p = b.select("i", F.col("v").cast("double").alias("v")).checkpoint()
    rr = r.agg(F.sum(F.col("v") ** 2)).first()[0] or 0.0
    goal = tol * tol * rr
    for _ in range(steps):
        if rr <= goal:
            break
        ap = matvec(a, p).select("i", F.col("v").alias("ap"))
        both = p.join(ap, "i", "left").select("i", F.col("v").alias("p"), F.coalesce("ap", F.lit(0.0)).alias("ap")).checkpoint()
        alpha = rr / both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        x = x.join(both, "i").select("i", (F.col("v") + alpha * F.col("p")).alias("v")).checkpoint()
        r = r.join(both, "i").select("i", (F.col("v") - alpha * F.col("ap")).alias("v")).checkpoint()
        new = r.agg(F.sum(F.col("v") ** 2)).first()[0]
        p = r.join(both.select("i", "p"), "i").select("i", (F.col("v") + new / rr * F.col("p")).alias("v")).checkpoint()
        rr = new
    return x
