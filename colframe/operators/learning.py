"""Classical learning: scaling, encoding, splits, regression, neighbours, k-means, as aggregates over features in arrays."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.functions import vectors as V
from colframe.operators.matrices import normal_equations
from colframe.operators.ordered import numbered
from colframe.shipping import ship
from colframe.sources.scratch import Scratch


def split(df: DataFrame, order: str, test_size: float, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last ceil(n * test_size) rows, between 1 and n - 1, in the order of a unique column are the test.

    With a seed rows are shuffled first: their order is that of the MD5 of "seed:value". Rows are numbered in range
    partitions, so no task gets the whole table.
    """
    by = F.col(order) if seed is None else F.md5(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string")))
    at = numbered(df.withColumn("_order", by), "_order", "_number").drop("_order")
    n = at.count()
    train = n - min(max(int(np.ceil(n * test_size)), 1), n - 1)
    return at.where(F.col("_number") < train).drop("_number"), at.where(F.col("_number") >= train).drop("_number")


def shuffle_rows(df: DataFrame, key: str, seed: int, name: str = "at") -> DataFrame:
    """df with each row's place in a seeded shuffle, by the MD5 of "seed:key"."""
    by = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return numbered(df.withColumn("_order", by), "_order", name).drop("_order")


class StandardScaler:
    """(x - mean) / population deviation; a constant column is only centred."""

    def fit(self, df: DataFrame, columns: list[str]) -> StandardScaler:
        row = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
        self.columns, self.mean = columns, [float(v) for v in row[::2]]
        self.scale = [float(v) if v else 1.0 for v in row[1::2]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(self.columns, self.mean, self.scale)})


class LabelEncoder:
    """Sorted classes as 0..k-1; a class that was not seen raises."""

    def fit(self, df: DataFrame, column: str) -> LabelEncoder:
        from colframe.operators.reshape import categories

        self.classes = categories(df, column)
        return self

    def transform(self, df: DataFrame, column: str, code: str) -> DataFrame:
        c = self.classes.select(F.col("category").alias(column), F.col("code").alias("_code"))
        seen = F.coalesce("_code", F.raise_error(F.concat(F.lit("unseen label "), F.coalesce(column, F.lit("NULL")))).cast("bigint"))
        return df.join(c, column, "left").withColumn(code, seen).drop("_code")

    def inverse(self, df: DataFrame, code: str, column: str) -> DataFrame:
        return df.join(self.classes.select(F.col("code").alias(code), F.col("category").alias(column)), code, "left")


class LinearRegression:
    """Ordinary least squares from one pass of normal equations."""

    def fit(self, df: DataFrame, features: str, target: str) -> LinearRegression:
        xtx, xty, _ = normal_equations(df, features, target)
        w = np.linalg.solve(xtx, xty)
        self.intercept, self.coef = float(w[0]), [float(v) for v in w[1:]]
        return self

    def predict(self, features: Column) -> Column:
        return V.dot(features, F.array(*map(F.lit, self.coef))) + self.intercept


class LogisticRegression:
    """Full-batch gradient descent from zero, without regularisation.

    Each iteration is one pass in which tasks sum their gradient, over features cached as Arrow blocks of rows.
    """

    def __init__(self, rate: float = 0.1, iterations: int = 500):
        self.rate, self.iterations = rate, iterations

    def fit(self, df: DataFrame, features: str, target: str) -> LogisticRegression:
        spark = df.sparkSession
        ship(spark)

        def pack(batches):
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
                    y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["n", "x", "y"])

        blocks = df.select(F.col(features).cast("array<double>"), F.col(target).cast("double")).mapInArrow(pack, "n long, x binary, y binary").persist()
        n, width = blocks.agg(F.sum("n"), F.max(F.octet_length("x") / F.col("n") / 8)).first()
        w = np.zeros(int(width) + 1)
        for _ in range(self.iterations):

            def gradient(batches, w=w):
                total = np.zeros(len(w))
                for b in batches:
                    for rows, x, y in zip(*(b.column(i).to_pylist() for i in range(3))):
                        x, y = np.frombuffer(x).reshape(rows, -1), np.frombuffer(y)
                        e = 1 / (1 + np.exp(-(x @ w[1:] + w[0]))) - y
                        total += np.concatenate([[e.sum()], x.T @ e])
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

            parts = blocks.mapInArrow(gradient, "g array<double>").select(F.posexplode("g").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
            g = np.zeros(len(w))
            for r in parts:
                g[r.at] = r.v
            w = w - self.rate * g / n
        blocks.unpersist()
        self.intercept, self.coef = float(w[0]), [float(v) for v in w[1:]]
        return self

    def predict_proba(self, features: Column) -> Column:
        return 1 / (1 + F.exp(-(V.dot(features, F.array(*map(F.lit, self.coef))) + self.intercept)))

    def predict(self, features: Column) -> Column:
        return (self.predict_proba(features) >= 0.5).cast("bigint")


#: Rows of a block of queries or training points.
BLOCK = 2048


def k_nearest(train: DataFrame, queries: DataFrame, id_: str, features: str, order: str, k: int, payload: str) -> DataFrame:
    """(query, rank, value): payload of each query's k nearest training rows by squared distance, ties by order.

    Queries are searched in blocks; each block goes over the training table once, tasks keeping their k best, and is
    saved before the next one is read.
    """
    spark = train.sparkSession
    ship(spark)
    scratch = Scratch(spark, "nearest")
    n = queries.count()
    parts = max(1, -(-n // BLOCK))
    table = train.select(F.col(features).cast("array<double>"), F.col(order).cast("bigint"), F.col(payload).cast("double"))
    found = []
    for i in range(parts):
        some = queries.where(F.pmod(F.xxhash64(id_), F.lit(parts)) == i) if parts > 1 else queries
        got = some.select(id_, F.col(features).cast("array<double>").alias("x")).toArrow()  # a block of bounded size
        ids, x = got.column(0).to_pylist(), np.array(got.column(1).to_pylist(), float)
        if not ids:
            continue
        shared = spark.sparkContext.broadcast((ids, x))

        def search(batches, shared=shared):
            ids, x = shared.value
            best = [[] for _ in ids]
            for b in batches:
                if not b.num_rows:
                    continue
                y = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
                at, value = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                yy = (y**2).sum(1)
                for a in range(0, len(ids), 256):
                    q = x[a : a + 256]
                    xx = (q**2).sum(1)[:, None]
                    d = xx + yy - 2 * q @ y.T
                    slack = 1e-12 * (xx + yy)  # of the expanded form; all rows within it are computed exactly
                    limit = np.partition(d + slack, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(q), np.inf)
                    for j in range(len(q)):
                        row = np.flatnonzero(d[j] - slack[j] <= limit[j])
                        exact = ((q[j] - y[row]) ** 2).sum(1)
                        best[a + j] = sorted([*best[a + j], *zip(exact.tolist(), at[row].tolist(), value[row].tolist())])[:k]
            rows = [(i, *r) for i, found in zip(ids, best) for r in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.float64(), pa.int64(), pa.float64()))], ["query", "d", "at", "value"])

        found.append(scratch.save(table.mapInArrow(search, "query long, d double, at long, value double")))
        shared.unpersist()
    if not found:
        return spark.createDataFrame([], "query long, rank int, value double")
    out = reduce(DataFrame.union, found)
    top = out.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "at", "value"))), 1, k).alias("top"))
    return top.select("query", F.posexplode("top").alias("rank", "r")).select("query", "rank", F.col("r.value").alias("value"))


def knn_classify(train: DataFrame, queries: DataFrame, id_: str, features: str, order: str, label: str, k: int) -> DataFrame:
    """(query, label): majority among the k nearest, ties to the smallest label."""
    votes = k_nearest(train, queries, id_, features, order, k, label).groupBy("query", F.col("value").cast("bigint").alias("label")).agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("query", F.col("best.label").alias("label"))


def knn_regress(train: DataFrame, queries: DataFrame, id_: str, features: str, order: str, target: str, k: int) -> DataFrame:
    return k_nearest(train, queries, id_, features, order, k, target).groupBy("query").agg(F.avg("value").alias("prediction"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each column of x, as KMeans.predict: squares added in order, NaN farthest, ties to the lowest."""
    own, best = np.zeros(x.shape[1], np.int64), None
    for c, centre in enumerate(centres):
        far = np.zeros(x.shape[1])
        with np.errstate(invalid="ignore", over="ignore"):
            for v, at in zip(x, centre):
                far += (v - at) * (v - at)
        if best is None:
            best = far
            continue
        closer = (far < best) | (np.isnan(best) & ~np.isnan(far))
        own[closer], best[closer] = c, far[closer]
    return own


class KMeans:
    """Lloyd's algorithm from the first k rows by order; ties to the lowest centre, empty clusters keep theirs."""

    def __init__(self, k: int, iterations: int = 100):
        self.k, self.iterations = k, iterations

    def fit(self, df: DataFrame, features: str, order: str) -> KMeans:
        """Each step is one pass in which tasks assign their rows and sum them by centre, over features cached as Arrow
        blocks. Vectors without a cluster, for predict gives null where one is null or holds null, take no part."""
        spark = df.sparkSession
        ship(spark)
        x = F.col(features).cast("array<double>")
        self.centres = [list(r[0]) for r in df.orderBy(order).limit(self.k).select(x).collect()]
        if not self.centres:
            return self
        width = len(self.centres[0])

        def pack(batches):
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, width)
                    yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], ["x"])

        whole = (F.size(features) == width) & ~F.exists(features, lambda v: v.isNull())
        blocks = df.where(whole).select(x).mapInArrow(pack, "x binary").persist()
        for _ in range(self.iterations):
            centres = np.array(self.centres, float)

            def sums(batches, centres=centres):
                total = np.zeros((len(centres), 1 + width))
                for b in batches:
                    for x in b.column(0).to_pylist():
                        x = np.frombuffer(x).reshape(width, -1)
                        own = _nearest(x, centres)
                        for c in range(len(centres)):
                            rows = x[:, own == c]
                            total[c] += [rows.shape[1], *rows.sum(1)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["c", "s"])

            parts = blocks.mapInArrow(sums, "c int, s array<double>").select("c", F.posexplode("s").alias("at", "v")).groupBy("c", "at").agg(F.sum("v").alias("v")).collect()
            total = np.zeros((len(centres), 1 + width))
            for r in parts:  # k centres
                total[r.c, r.at] = r.v
            filled = total[:, :1] > 0
            new = np.where(filled, total[:, 1:] / np.where(filled, total[:, :1], 1), centres)
            self.centres = new.tolist()
            if np.array_equal(new, centres, equal_nan=True):
                break
        blocks.unpersist()
        return self

    def predict(self, features: Column) -> Column:
        far = F.array(*[F.aggregate(F.zip_with(features, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in self.centres])
        return V.argmin(far).cast("int")


class Artifact:
    """Portable JSON form of a linear, logistic or scaler model, and its scoring expression."""

    def __init__(self, kind: str, values: dict):
        self.kind, self.values = kind, values

    @classmethod
    def of(cls, model) -> Artifact:
        if isinstance(model, StandardScaler):
            return cls("standard_scaler", {"mean": model.mean, "scale": model.scale})
        return cls("logistic_regression" if isinstance(model, LogisticRegression) else "linear_regression", {"coef": model.coef, "intercept": model.intercept})

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, **self.values})

    @classmethod
    def from_json(cls, text: str) -> Artifact:
        values = json.loads(text)
        kind = values.pop("kind")
        if kind not in ("standard_scaler", "logistic_regression", "linear_regression"):
            raise ValueError(kind)
        return cls(kind, values)

    def save(self, spark: SparkSession, path: str) -> None:
        """As a text file by Spark's writer, so any store works."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Artifact:
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])

    def apply(self, features: Column) -> Column:
        if self.kind == "standard_scaler":
            pairs = F.arrays_zip(features.alias("x"), F.array(*map(F.lit, self.values["mean"])).alias("m"), F.array(*map(F.lit, self.values["scale"])).alias("s"))
            return F.transform(pairs, lambda r: (r["x"] - r["m"]) / r["s"])
        z = V.dot(features, F.array(*map(F.lit, self.values["coef"]))) + self.values["intercept"]
        return z if self.kind == "linear_regression" else 1 / (1 + F.exp(-z))
