"""Missing values and IEEE semantics as Column expressions.

NaN counts as missing in frames: NULL and NaN are one state. Comparisons with a missing value are false. Division and
logarithms follow IEEE 754 rather than ANSI errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOATS)


def is_numeric(df: DataFrame, name: str) -> bool:
    """Numbers and booleans, which behave as 0 and 1."""
    return isinstance(df.schema[name].dataType, (*FLOATS, *INTEGERS, T.DecimalType, T.BooleanType))


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    c = F.col(name)
    return F.when(~F.isnan(c), c) if is_float(df, name) else c


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: missing values are NULL, booleans 0 and 1."""
    if not is_numeric(df, name):
        raise TypeError(f"column {name} is not numeric")
    return clean(df, name).cast("double")


def missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c.isNull() | F.isnan(c) if is_float(df, name) else c.isNull()


def definite(condition: Column) -> Column:
    """Two-valued form of a condition: unknown is false."""
    return F.coalesce(condition, F.lit(False))


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b with inf and NaN for a zero divisor."""
    signed = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, signed).otherwise(F.try_divide(a, b))


def ieee_log(x: Column) -> Column:
    """Natural logarithm with -inf at 0 and NaN below."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))


def round_away(x: Column) -> Column:
    """Rounds halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
