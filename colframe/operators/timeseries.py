"""Rolling windows and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colframe.functions.cleaning import as_double, is_numeric

STEP = {"h": "1 hour", "D": "1 day"}
UNIT = {"h": "hour", "D": "day"}


def rolling(df: DataFrame, name: str, window: int, what: str, order: list[str], by: list[str] | None = None) -> Column:
    """Mean or sum of the last ``window`` rows; NULL unless all of them have values.

    With ``by`` each series is a window partition of its own. Without it a whole table is one series: use rolling_blocks.
    """
    x = as_double(df, name)
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(-(window - 1), 0)
    return F.when(F.count(x).over(w) >= window, {"mean": F.avg, "sum": F.sum}[what](x).over(w))


def rolling_blocks(df: DataFrame, names: list[str], window: int, what: str, order: str, width: int) -> DataFrame:
    """Rolling columns ``{name}_{what}`` over a whole table ordered by a dense integer column.

    Rows go to the block of their position and, if they are among the last window - 1 of a block, also to the next
    one, so each block has the rows that its windows reach back to. width must be at least window.
    """
    if width < window:
        raise ValueError("a block must hold a window")
    block = F.floor(F.col(order) / width)
    near = F.when(F.pmod(F.col(order), F.lit(width)) >= width - (window - 1), F.array(block, block + 1)).otherwise(F.array(block))
    spread = df.select("*", F.explode(near).alias("_block"))
    out = spread.withColumns({f"{c}_{what}": rolling(spread, c, window, what, [order], ["_block"]) for c in names})
    return out.where(F.col("_block") == block).drop("_block")


def floor_bin(ts: str, freq: str) -> Column:
    """Start of the hour or day of a timestamp without zone."""
    return F.date_trunc(UNIT[freq], F.col(ts)).cast("timestamp_ntz")


def resample(df: DataFrame, ts: str, freq: str, what: str) -> DataFrame:
    """Mean or sum of all numeric columns in bins of an hour (h) or a day (D), every bin between the first and last.

    Bins without rows have mean NULL and sum 0. The input needs no order.
    """
    names = [c for c in df.columns if c != ts and is_numeric(df, c)]
    f = {"mean": F.avg, "sum": F.sum}[what]
    binned = df.where(F.col(ts).isNotNull()).groupBy(floor_bin(ts, freq).alias(ts)).agg(*[f(as_double(df, c)).alias(c) for c in names])
    spine = binned.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).where("a is not null").select(F.explode(F.expr(f"sequence(a, b, interval {STEP[freq]})")).alias(ts))
    out = spine.join(binned, ts, "left")
    return out.na.fill(0.0, names) if what == "sum" else out


def date_range(spark, start: str, periods: int, freq: str) -> DataFrame:
    """periods timestamps from start in steps of an hour or a day."""
    return spark.range(periods).select(F.expr(f"timestamp_ntz'{start}' + make_interval(0,0,0,0,{'cast(id as int)' if freq == 'h' else 'cast(id as int) * 24'},0,0)").alias("ts"))
