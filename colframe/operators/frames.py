"""Frame operations: projection, filters, joins, aggregates, sorting and slicing.

Two flavours exist where semantics differ: ``missing="nan"`` (NaN is missing, aggregates are doubles, an empty sum is
0) and ``missing="null"`` (integers stay integers, empty aggregates are NULL). Row order is explicit: operations that
depend on it take the name of a unique order column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colframe.functions.cleaning import FLOATS, as_double, clean, is_numeric, missing
from colframe.operators.ordered import before, quantiles, spread
from colframe.shipping import ship

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


# --- construction, projection, metadata

def require(df: DataFrame, *names: str) -> None:
    """Raises KeyError for names that are not columns."""
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise KeyError(f"no such column: {', '.join(lost)}")


def select(df: DataFrame, names: list[str]) -> DataFrame:
    require(df, *names)
    return df.select(*names)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Renames columns; the resulting names have to be unique."""
    require(df, *mapping)
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("duplicate column names")
    return df.toDF(*names)


def with_columns(df: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """Replaces columns of the same name in place and appends the others."""
    return df.withColumns(extra)


def checksum(df: DataFrame) -> DataFrame:
    """One row: rows + columns + sum of all values; text counts by its bytes, missing values as 0."""
    parts = [F.sum(F.octet_length(c).cast("double")) if not is_numeric(df, c) else F.sum(as_double(df, c)) for c in df.columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts], F.lit(0.0))
    return df.agg((F.count("*") + F.lit(len(df.columns)) + total).alias("checksum"))


# --- filters

def filter_gt(df: DataFrame, name: str, threshold: float) -> DataFrame:
    """Rows whose value exceeds the threshold; NaN doesn't. The plain comparison reaches the scan."""
    condition = F.col(name) > threshold
    if isinstance(df.schema[name].dataType, FLOATS):
        condition &= ~F.isnan(name)
    return df.filter(condition)


def dropna(df: DataFrame, how: str = "any") -> DataFrame:
    """Rows without a missing value (any), or with a value at least (all); NaN is missing."""
    if how not in ("any", "all"):
        raise ValueError(how)
    lost = [missing(df, c) for c in df.columns]
    return df.filter(~reduce((lambda a, b: a | b) if how == "any" else (lambda a, b: a & b), lost))


def fillna(df: DataFrame, value: float, text: str | None = None) -> DataFrame:
    """Fills missing numbers (integers with the truncated value), booleans with value != 0, and text if asked."""
    out = {}
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            out[c] = F.when(missing(df, c), F.lit(float(value))).otherwise(F.col(c)).cast(kind)
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            out[c] = F.coalesce(F.col(c), F.lit(int(value)).cast(kind))
        elif kind == "boolean":
            out[c] = F.coalesce(F.col(c), F.lit(value != 0))
        elif kind == "string" and text is not None:
            out[c] = F.coalesce(F.col(c), F.lit(text))
    return df.withColumns(out)


def map_values(df: DataFrame, name: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with f of a float column, called on arrays of values; a missing value goes in as NaN, and NaN comes back as NULL."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(x.to_numpy(float)), float))

    if not isinstance(df.schema[name].dataType, FLOATS):
        raise TypeError(f"{name} is not a float column")
    return df.withColumn(name, run(F.coalesce(F.col(name).cast("double"), F.lit(float("nan")))))


def apply_values(df: DataFrame, name: str, f: Callable[[float], float]) -> DataFrame:
    """map_values() for a function of one number; batches still travel as arrays."""
    return map_values(df, name, lambda x: np.fromiter(map(f, x.tolist()), float, len(x)))


class Indexed:
    """A table with an index: a column that is no value of its rows, by which they are ordered and resampled."""

    def __init__(self, df: DataFrame, index: str):
        require(df, index)
        self.df, self.index = df, index

    def head(self, n: int) -> DataFrame:
        return head(self.df, n, self.index)

    def tail(self, n: int) -> DataFrame:
        return tail(self.df, n, self.index)

    def between(self, low, high) -> DataFrame:
        """Rows whose index is from low up to but not high; the comparison reaches the scan."""
        return self.df.where((F.col(self.index) >= F.lit(low)) & (F.col(self.index) < F.lit(high)))

    def resample(self, freq: str, what: str) -> DataFrame:
        from colframe.operators.timeseries import resample

        return resample(self.df, self.index, freq, what)

    def values(self) -> DataFrame:
        return self.df.drop(self.index)


def set_index(df: DataFrame, index: str) -> Indexed:
    return Indexed(df, index)


# --- joins

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def merge(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join on columns of the same names; missing keys match each other.

    Columns: keys, the left's others, the right's others; names on both sides get the suffixes. Catalyst chooses the
    strategy: the null-safe condition stays an equi-join, so broadcast, sort-merge and skew handling all apply.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {sorted(HOW)}")
    on = [on] if isinstance(on, str) else list(on)
    require(left, *on)
    require(right, *on)
    lrest, rrest = ([c for c in x.columns if c not in on] for x in (left, right))
    both = set(lrest) & set(rrest)
    a = left.select(*[clean(left, c).alias(f"l{i}") for i, c in enumerate(on)], *[F.col(c).alias(f"lv{i}") for i, c in enumerate(lrest)])
    b = right.select(*[clean(right, c).alias(f"r{i}") for i, c in enumerate(on)], *[F.col(c).alias(f"rv{i}") for i, c in enumerate(rrest)])
    condition = reduce(lambda x, y: x & y, [F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")) for i in range(len(on))])
    out = a.join(b, condition, HOW[how])
    keys = [F.coalesce(f"l{i}", f"r{i}").alias(c) for i, c in enumerate(on)]
    return out.select(
        *keys,
        *[F.col(f"lv{i}").alias(c + suffixes[0] * (c in both)) for i, c in enumerate(lrest)],
        *[F.col(f"rv{i}").alias(c + suffixes[1] * (c in both)) for i, c in enumerate(rrest)],
    )


def join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Inner or left equi-join whose colliding right names get ``_right``."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    return merge(left, right, on, how, ("", "_right"))


# --- aggregates

def _aggregate(df: DataFrame, name: str, what: str, flavour: str) -> Column:
    if what not in ("sum", "mean", "count", "min", "max"):
        raise ValueError(what)
    alias = f"{name}_{what}"
    if flavour == "nan":
        x = as_double(df, name) if is_numeric(df, name) else clean(df, name)
        if what == "count":
            return F.count(x).cast("double").alias(alias)
        f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[what](x)
        return (F.coalesce(f, F.lit(0.0)) if what == "sum" else f).alias(alias)
    x, kind = F.col(name), dict(df.dtypes)[name]
    if what == "count":
        return F.count(x).alias(alias)
    if what == "mean":
        return F.avg(x.cast("double")).alias(alias)
    if what == "sum" and kind in ("bigint", "int", "smallint", "tinyint"):  # saturating
        total = F.sum(x.cast("decimal(38,0)"))
        return F.greatest(F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")), F.lit(LONG_MIN).cast("decimal(38,0)")).cast("bigint").alias(alias)
    if what == "sum" and kind == "boolean":
        return F.sum(x.cast("bigint")).alias(alias)
    return {"sum": F.sum, "min": F.min, "max": F.max}[what](x).alias(alias)


def group(df: DataFrame, keys: list[str] | str, aggs: list[tuple[str, str]], missing: str = "nan") -> DataFrame:
    """Grouped sum, mean, count, min and max named ``{column}_{aggregate}``; missing keys form a group.

    An aggregate of a key column is left out (nan flavour). Partial aggregation runs before the shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    require(df, *keys, *[c for c, _ in aggs])
    made = [_aggregate(df, c, a, missing) for c, a in aggs if not (missing == "nan" and c in keys)]
    return df.groupBy(*[clean(df, k).alias(k) for k in keys]).agg(*made)


def reduce_all(df: DataFrame, what: str) -> DataFrame:
    """Sum or mean of every numeric column, skipping missing values, as one row."""
    f = {"sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)), "mean": F.avg}[what]
    return df.agg(*[f(as_double(df, c)).alias(c) for c in df.columns if is_numeric(df, c)])


STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, label: str | None = None) -> DataFrame:
    """Eight rows of statistics of every numeric column (exact, linearly interpolated percentiles).

    With ``label`` a column of that name holds the statistic's name.
    """
    names = [c for c in df.columns if is_numeric(df, c)]
    x = {c: as_double(df, c) for c in names}
    row = df.agg(*[f for c in names for f in (F.count(x[c]), F.avg(x[c]), F.stddev_samp(x[c]), F.min(x[c]), F.max(x[c]))]).first()
    middle = quantiles(df, x, [0.25, 0.5, 0.75])
    columns = []
    for i, c in enumerate(names):
        n, mean, std, low, high = row[5 * i : 5 * i + 5]
        columns.append([float(n), mean, std if n > 1 else None, low, *middle[c], high])
    schema = ", ".join([*([f"`{label}` string"] if label else []), *(f"`{c}` double" for c in names)])
    rows = [(*([s] if label else []), *(v[i] for v in columns)) for i, s in enumerate(STATISTICS)]
    return df.sparkSession.createDataFrame(rows, schema)


# --- order

def sort_values(df: DataFrame, by: list[str] | str, ascending: bool = True, order: str | None = None) -> DataFrame:
    """Stable sort: missing values last ascending and first descending; ties keep the order of column ``order``."""
    by = [by] if isinstance(by, str) else list(by)
    keys = [clean(df, c).asc_nulls_last() if ascending else clean(df, c).desc_nulls_first() for c in by]
    return df.orderBy(*keys, *([F.col(order).asc()] if order else []))


def head(df: DataFrame, n: int, order: list[str] | str) -> DataFrame:
    """First n rows by order: a top-k, without a full sort."""
    return df.orderBy(order).limit(n)


def tail(df: DataFrame, n: int, order: list[str] | str) -> DataFrame:
    names = [order] if isinstance(order, str) else order
    return df.orderBy(*[F.col(c).desc() for c in names]).limit(n)


def slice_rows(df: DataFrame, offset: int, length: int, order: str) -> DataFrame:
    """length rows from offset on (from the end if negative) in the order of a column."""
    if offset < 0:
        offset = max(0, df.count() + offset)
    return df.orderBy(order).offset(offset).limit(length)


def take_rows(df: DataFrame, positions: DataFrame, position: str) -> DataFrame:
    """Rows of df at positions(at, i): row i of the result is the one whose ``position`` column is at."""
    return positions.join(df, positions["at"] == df[position]).drop("at")


def running(df: DataFrame, order: str, **aggregates: str) -> DataFrame:
    """Running aggregates over a whole table in the order of a unique column.

    aggregates: name = "sum:column", "prod:column" or "count". Windows run inside range partitions, whose totals are
    combined one row each, so no task gets the whole table.
    """
    parts = spread(df, order)
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own, totals, rules, made = {}, {}, {}, {}
    for name, what in aggregates.items():
        kind, _, column = what.partition(":")
        x = F.lit(1) if kind == "count" else F.col(column).cast("double") if kind == "prod" or dict(df.dtypes)[column] in ("double", "float") else F.col(column).cast("bigint")
        f = F.product if kind == "prod" else F.sum
        own[name], totals[f"_{name}"] = f(x).over(inside), f(x)
        zero = 1.0 if kind == "prod" else 0.0 if kind == "sum" and dict(df.dtypes)[column] in ("double", "float") else 0
        rules[f"_{name}"] = (zero, (lambda a, b: a * b) if kind == "prod" else (lambda a, b: a + b))
        made[name] = kind
    out = parts.withColumns(own).join(before(parts, totals, rules), "_part")
    both = {n: F.col(f"_{n}") * F.col(n) if kind == "prod" else F.col(f"_{n}") + F.col(n) for n, kind in made.items()}
    return out.withColumns(both).drop("_part", *totals)


def rankdata(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """1-based ranks, ties getting their average, over a whole table; NaN ranks last, a null value has a null rank.

    Counts are taken per distinct value, and running totals of those inside range partitions.
    """
    v = spread(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")), value)
    less = F.sum("_n").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    v = v.withColumn("_less", F.coalesce(less, F.lit(0))).join(before(v, {"_before": F.sum("_n")}, {"_before": (0, lambda a, b: a + b)}), "_part")
    return df.join(v.select(value, (F.col("_before") + F.col("_less") + (F.col("_n") + 1) / 2).alias(name)), value, "left")
