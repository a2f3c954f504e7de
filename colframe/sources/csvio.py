"""CSV with inference by ladder: bool (optional), integer, float, text; empty cells are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOL, INT, FLOAT = r"(?i)^(true|false)$", r"^[+-]?\d{1,18}(\.0*)?$", r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|nan|NaN|Infinity|-Infinity)$"


def read(spark: SparkSession, path: str, booleans: bool = True, lines: bool = True) -> DataFrame:
    """Reads CSV with a header. Types come from one aggregate over all cells, not from a sample.

    A column without any value becomes boolean (booleans) or double. lines: quoted cells may hold line ends, for which
    a file has to be one task; without them large files are split.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=lines, quote='"', escape='"', nullValue="", emptyValue="", mode="FAILFAST")
    names = raw.columns

    def fits(c: str, pattern: str):
        return F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`").rlike(pattern)))

    row = raw.agg(*[f(c) for c in names for f in (lambda c: F.count(f"`{c}`"), lambda c: fits(c, BOOL), lambda c: fits(c, INT), lambda c: fits(c, FLOAT))]).first()
    out = []
    for i, c in enumerate(names):
        n, is_bool, is_int, is_float = row[4 * i : 4 * i + 4]
        x = F.col(f"`{c}`")
        if not n:
            kind = "boolean" if booleans else "double"
        elif booleans and is_bool:
            kind = "boolean"
        elif is_int:
            x, kind = F.regexp_replace(x, r"\.0*$", ""), "bigint"
        else:
            kind = "double" if is_float else "string"
        out.append(x.cast(kind).alias(c))
    return raw.select(*out)


def write(df: DataFrame, path: str, integral: bool = False) -> None:
    """Writes CSV with a header, minimal quoting, True/False and empty cells for missing values.

    With ``integral`` doubles without a fraction are written as integers.
    """
    out = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind == "boolean":
            x = F.initcap(x.cast("string"))
        elif kind in ("double", "float"):
            x = F.when(~F.isnan(x), x)
            if integral:
                x = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
        elif kind.startswith("array"):
            x = F.lit("[]")
        out.append(x.alias(c))
    df.select(*out).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue='""', escape='"')
