"""Resampling of unbounded tables: the batch operators' bins as event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colframe.operators.timeseries import STEP


def resample(stream: DataFrame, ts: str, value: str, freq: str, late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Mean, sum and count of value in bins of an hour (h) or a day (D); rows later than ``late`` are dropped.

    State is one row for each open bin and key; bins without rows do not appear, unlike in the batch form.
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    binned = timed.groupBy(F.window("_ts", STEP[freq]).alias("_w"), *(by or [])).agg(F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.count(value).alias("n"))
    return binned.select(F.col("_w.start").alias(ts), *(by or []), "mean", "sum", "n")


def sliding(stream: DataFrame, ts: str, value: str, width: str, step: str, late: str = "1 hour") -> DataFrame:
    """Mean in overlapping windows."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width, step).alias("_w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("_w.start").alias(ts), "mean", "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a key, closed by a gap."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.session_window("_ts", gap).alias("_w"), key).agg(F.count("*").alias("n")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")
