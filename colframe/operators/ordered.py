"""Global order without a global task: rows in range partitions, whose totals are added up on the driver.

A table is range-partitioned by its order and saved, so that each row's partition is fixed. Windows run inside
partitions; only one row of totals a partition leaves them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colframe.sources.scratch import Scratch


def spread(df: DataFrame, *order: str) -> DataFrame:
    """df with ``_part``, the number of its range partition by ``order``; equal rows share one."""
    if df.limit(1).count():
        df = df.repartitionByRange(*order)
    return Scratch(df.sparkSession, "spread").save(df.withColumn("_part", F.spark_partition_id()))


def before(parts: DataFrame, totals: dict[str, Column], combine: dict[str, tuple[object, Callable]]) -> DataFrame:
    """A row for each partition of spread(): ``_part`` and, by name, the totals of all partitions before it.

    combine: start value and function of each total.
    """
    rows = sorted(parts.groupBy("_part").agg(*[c.alias(n) for n, c in totals.items()]).collect(), key=lambda r: r["_part"])  # a row a partition
    state, out = {n: combine[n][0] for n in totals}, []
    for r in rows:
        out.append((r["_part"], *state.values()))
        state = {n: combine[n][1](v, r[n]) if r[n] is not None else v for n, v in state.items()}
    kind = {int: "bigint", float: "double"}
    schema = ", ".join(["_part int", *(f"`{n}` {kind[type(combine[n][0])]}" for n in totals)])
    return F.broadcast(parts.sparkSession.createDataFrame(out, schema))


def numbered(df: DataFrame, order: str, name: str, first: int = 0) -> DataFrame:
    """df with the number of each row in the order of a unique column."""
    parts = spread(df, order)
    add = before(parts, {"_before": F.count("*")}, {"_before": (0, lambda a, b: a + b)})
    at = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    out = parts.withColumn("_at", at).join(add, "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_at") + (first - 1)).cast("bigint")).drop("_part", "_at", "_before")


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns with linear interpolation; null values are left out.

    Values are counted first, so a frequent value is one row; (column, value, count) is range-partitioned, and from
    the partitions' totals only the rows at the wanted ranks are fetched.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), x.cast("double").alias("x")) for i, x in enumerate(columns.values())])).alias("p")
    counted = df.select(pairs).select("p.c", "p.x").where("x is not null").groupBy("c", "x").agg(F.count("*").alias("n"))
    parts = spread(counted, "c", "x")
    totals = parts.groupBy("_part", "c").agg(F.sum("n").alias("n")).collect()  # a row for each column and partition
    wanted, ranks = [], {}
    for i in range(len(columns)):
        own = sorted((r["_part"], r["n"]) for r in totals if r["c"] == i)
        size = sum(n for _, n in own)
        ranks[i] = size
        for k in {int(f) for s in shares for f in ((size - 1) * s, min(size - 1, int((size - 1) * s) + 1))} if size else ():
            seen = 0
            for part, n in own:
                if k < seen + n:
                    wanted.append((part, i, k, k - seen))
                    break
                seen += n
    found = {}
    if wanted:
        asked = F.broadcast(df.sparkSession.createDataFrame(wanted, "_part int, c int, k bigint, local bigint"))
        upto = F.sum("n").over(Window.partitionBy("_part", "c").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        some = parts.join(asked.select("_part", "c").distinct(), ["_part", "c"], "left_semi").withColumn("upto", upto)
        at = some.join(asked, ["_part", "c"]).where((F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("n")))
        found = {(r["c"], r["k"]): r["x"] for r in at.select("c", "k", "x").collect()}
    out = {}
    for i, name in enumerate(columns):
        out[name] = []
        for s in shares:
            if not ranks[i]:
                out[name].append(None)
                continue
            at = (ranks[i] - 1) * s
            low, high = found[i, int(at)], found[i, min(ranks[i] - 1, int(at) + 1)]
            out[name].append(low + (high - low) * (at - int(at)))
    return out
