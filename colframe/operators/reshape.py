"""Reshaping: melt, pivot tables, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colframe.functions.cleaning import as_double, clean, is_numeric
from colframe.operators.ordered import numbered


def _text(df: DataFrame, name: str) -> Column:
    """A value as text; booleans as True and False."""
    kind = dict(df.dtypes)[name]
    return F.initcap(F.col(name).cast("string")) if kind == "boolean" else F.col(name).cast("string")


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None) -> DataFrame:
    """Wide to long: ids, ``variable`` and ``value``, a double if all values are numeric and text else."""
    values = values or [c for c in df.columns if c not in ids]
    numeric = all(is_numeric(df, c) for c in values)
    cast = df.select(*ids, *[(as_double(df, c) if numeric else _text(df, c)).alias(c) for c in values])
    return cast.unpivot(ids, values, "variable", "value")


def pivot_table(df: DataFrame, index: str, columns: str, values: str, agg: str = "mean", labels: list | None = None) -> DataFrame:
    """Long to wide; cells without rows are 0 for sum and count and NULL for mean, min and max.

    labels: the column values, if known, which spares a pass over the data.
    """
    x = as_double(df, values)
    f = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[agg](x).cast("double")
    label = F.coalesce(_text(df, columns), F.lit("nan"))
    out = df.withColumn("_label", label).groupBy(clean(df, index).alias(index)).pivot("_label", labels).agg(f)
    return out.na.fill(0.0, [c for c in out.columns if c != index]) if agg in ("sum", "count") else out


def categories(df: DataFrame, name: str) -> DataFrame:
    """(category, code) of the distinct values in sorted order, codes from 0.

    Values are range-partitioned and numbered inside partitions, whose sizes are summed: no task gets all values.
    """
    distinct = df.select(F.col(name).alias("category")).where(F.col(name).isNotNull()).distinct()
    return numbered(distinct, "category", "code").select("category", "code")


def categorical_codes(df: DataFrame, name: str, code: str = "code") -> DataFrame:
    """df with the code of each value's category; -1 for a missing value."""
    cats = categories(df, name)
    return df.join(cats, df[name] == cats["category"], "left").drop("category").withColumn(code, F.coalesce(F.col("code"), F.lit(-1)).cast("bigint"))


def decode(codes: DataFrame, cats: DataFrame, code: str, name: str) -> DataFrame:
    """Category of each code; NULL for -1."""
    return codes.join(cats.select(F.col("code").alias(code), F.col("category").alias(name)), code, "left")
