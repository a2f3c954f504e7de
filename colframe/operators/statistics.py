"""Descriptive statistics, tests, integration and metrics as single-pass aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colframe.functions.special import betainc_


def moments(df: DataFrame, x: str) -> DataFrame:
    """One row: n, mean, var, std (population), skewness (0 if constant), kurtosis (-3 if constant) and sem."""
    c = F.col(x)
    v = F.var_pop(c)
    return df.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        v.alias("var"),
        F.stddev_pop(c).alias("std"),
        F.when(v == 0, 0.0).otherwise(F.skewness(c)).alias("skew"),
        F.when(v == 0, -3.0).otherwise(F.kurtosis(c)).alias("kurtosis"),
        (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("sem"),
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r from sums; 0 where a side is constant."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    mx, my = F.avg(x), F.avg(y)
    top = F.avg(x * y) - mx * my
    below = F.sqrt(F.greatest(F.var_pop(x) * F.var_pop(y), F.lit(0.0)))
    return F.when((n > 1) & (below > 0), F.least(F.greatest(top / below, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)


def _two_sided(t: float, df: float) -> float:
    return float(betainc_(df / 2, 0.5, np.array([df / (df + t * t)]))[0])


def pearsonr(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """Correlation and two-sided p-value; rows with a missing value are left out."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r, n = both.agg(correlation(F.col(x).cast("double"), F.col(y).cast("double")), F.count("*")).first()
    if n < 3 or abs(r) >= 1:
        return r, 0.0 if n >= 3 else 1.0
    return r, _two_sided(r * np.sqrt((n - 2) / (1 - r * r)), n - 2)


def spearmanr(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """Pearson's correlation of average ranks."""
    from colframe.operators.frames import rankdata

    return pearsonr(rankdata(rankdata(df, x, "_rx"), y, "_ry"), "_rx", "_ry")


def ttest_ind(df: DataFrame, x: str, group: str, a, b) -> tuple[float, float]:
    """Two-sample t statistic with pooled variance and its two-sided p-value."""
    rows = {r[0]: r for r in df.where(F.col(group).isin(a, b)).groupBy(group).agg(F.count(x), F.avg(x), F.var_samp(x)).collect()}
    (_, na, ma, va), (_, nb, mb, vb) = rows[a], rows[b]
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    t = (ma - mb) / np.sqrt(pooled * (1 / na + 1 / nb))
    return float(t), _two_sided(t, na + nb - 2)


def entropy(df: DataFrame, weight: str) -> DataFrame:
    """Shannon entropy (nats) of unnormalised weights: ln(S) - sum(w ln w) / S in one pass."""
    w = F.col(weight)
    s = F.sum(w)
    return df.agg((F.log(s) - F.sum(F.when(w > 0, w * F.log(w)).otherwise(0.0)) / s).alias("entropy"))


def logsumexp(df: DataFrame, x: str) -> DataFrame:
    """log of the sum of exponentials; the maximum is taken first so that nothing overflows."""
    top = df.agg(F.max(x)).first()[0]
    if top is None:
        return df.agg(F.lit(float("-inf")).alias("logsumexp"))
    return df.agg((F.lit(float(top)) + F.log(F.sum(F.exp(F.col(x) - float(top))))).alias("logsumexp"))


def trapezoid(df: DataFrame, y: str, order: str, by: list[str], dx: float = 1.0, x: str | None = None) -> DataFrame:
    """Trapezoid rule for each series, by samples dx apart or at x."""
    w = Window.partitionBy(*by).orderBy(order)
    width = F.col(x) - F.lag(x).over(w) if x else F.lit(dx)
    part = df.select(*by, ((F.col(y) + F.lag(y).over(w)) / 2 * width).alias("_a"))
    return part.groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def cumulative_trapezoid(df: DataFrame, y: str, order: str, by: list[str], dx: float = 1.0) -> DataFrame:
    """Running trapezoid of each series; the first sample has 0."""
    w = Window.partitionBy(*by).orderBy(order)
    part = F.coalesce((F.col(y) + F.lag(y).over(w)) / 2 * dx, F.lit(0.0))
    return df.withColumn("_a", part).withColumn("area", F.sum("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")


def simpson(df: DataFrame, y: str, order: str, by: list[str], dx: float = 1.0) -> DataFrame:
    """Composite Simpson rule for each series of an odd number of samples; with an even number the last interval
    gets the quadratic through the last three samples."""
    w = Window.partitionBy(*by).orderBy(order)
    r = df.select(*by, F.col(y).alias("_y"), (F.row_number().over(w) - 1).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    r = r.withColumn("_m", F.when(F.col("_n") % 2 == 1, F.col("_n")).otherwise(F.col("_n") - 1))
    i, n, m = F.col("_i"), F.col("_n"), F.col("_m")
    main = F.when((i >= m) | (m < 3), 0.0).when((i == 0) | (i == m - 1), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) / 3
    last = F.when((n % 2 == 1) | (n < 3), 0.0).when(i == n - 1, 5 / 12).when(i == n - 2, 8 / 12).when(i == n - 3, -1 / 12).otherwise(0.0)
    two = F.when(n == 2, 0.5).otherwise(0.0)
    return r.groupBy(*by).agg((F.sum(F.col("_y") * (main + last + two)) * dx).alias("area"))


def classification(df: DataFrame, truth: str, guess: str, positive=1) -> DataFrame:
    """accuracy, precision, recall and f1 in one pass; a zero denominator gives 0."""
    t, g = F.col(truth) == positive, F.col(guess) == positive
    both, pt, pg = F.count_if(t & g), F.count_if(t), F.count_if(g)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    p, r = ratio(both, pg), ratio(both, pt)
    return df.agg(
        ratio(F.count_if(F.col(truth) == F.col(guess)), F.count("*")).alias("accuracy"), p.alias("precision"), r.alias("recall"), ratio(2 * both, pt + pg).alias("f1")
    )


def regression(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """mse, mae and r2 in one pass; r2 is 0 for a constant truth."""
    e = F.col(truth) - F.col(guess)
    spread = F.var_pop(truth) * F.count("*")
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.when(spread == 0, 0.0).otherwise(1 - F.sum(e * e) / spread).alias("r2"))
