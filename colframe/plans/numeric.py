"""Queries over vectors, distributions, statistics and matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from colframe.functions import shapes as H
from colframe.functions import special as sp
from colframe.functions import vectors as V
from colframe.operators import autograd as A
from colframe.operators import batched as B
from colframe.operators import matrices as M
from colframe.operators import neural as N
from colframe.operators import statistics as S
from colframe.plans.catalog import register
from colframe.plans.relational import T, rounded

E = "SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings"


def vectors(spark, d):
    return T(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def digits(v, n=6):
    return F.transform(v, lambda x: F.round(x, n) + 0.0)


UNARY_SQL = {
    "sqrt": "CASE WHEN x < 0 THEN 'NaN'::double ELSE sqrt(abs(x)) END", "exp": "exp(x)", "log": "CASE WHEN x = 0 THEN '-Infinity'::double WHEN x < 0 THEN 'NaN'::double ELSE ln(abs(x)) END",
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "tanh": "tanh(x)", "negative": "-x", "abs": "abs(x)", "sign": "sign(x)::double", "square": "x*x", "reciprocal": "1/x", "floor": "floor(x)", "ceil": "ceil(x)",
    "trunc": "trunc(x)", "round": "round(x)", "relu": "greatest(x, 0.0)", "leaky_relu": "CASE WHEN x > 0 THEN x ELSE x * 0.01 END", "sigmoid": "1 / (1 + exp(-x))", "silu": "x / (1 + exp(-x))",
    "gelu": "0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))",
}
BINARY_SQL = {
    "add": "x + y", "subtract": "x - y", "multiply": "x * y", "divide": "x / y", "power": "pow(x, y)", "maximum": "greatest(x, y)", "minimum": "least(x, y)", "greater": "(x > y)::int::double",
    "greater_equal": "(x >= y)::int::double", "less": "(x < y)::int::double", "less_equal": "(x <= y)::int::double", "equal": "(x = y)::int::double", "not_equal": "(x <> y)::int::double",
}


def _unary(name):
    @register(f"vector_{name}", f"SELECT vec_id, list_transform(v, lambda x: round({UNARY_SQL[name]}, 6) + 0.0) AS r FROM ({E})")
    def _(spark, d):
        return vectors(spark, d).select("vec_id", digits(V.unary(name, F.col("v"))).alias("r"))


for name in UNARY_SQL:
    _unary(name)


def _binary(name):
    y = "abs(v[65 - i]) + 0.5" if name == "power" else "v[65 - i]"
    x = "abs(x)" if name == "power" else "x"
    body = BINARY_SQL[name].replace("x", "@").replace("y", f"({y})").replace("@", "x")
    body = body if name != "power" else f"pow(abs(x), {y})"
    if name in ("maximum", "minimum"):
        body = f"{'greatest' if name == 'maximum' else 'least'}(x, {y})"

    @register(f"vector_{name}", f"SELECT vec_id, list_transform(v, lambda x, i: round({body}, 6) + 0.0) AS r FROM ({E})")
    def _(spark, d):
        a, b = F.col("v"), F.reverse("v")
        if name == "power":
            a, b = F.transform(a, F.abs), F.transform(b, lambda x: F.abs(x) + 0.5)
        return vectors(spark, d).select("vec_id", digits(V.binary(name, a, b)).alias("r"))


for name in BINARY_SQL:
    _binary(name)


@register("vector_scalar_broadcast", f"SELECT vec_id, list_transform(v, lambda x: round(x * (vec_id % 3), 6) + 0.0) AS r FROM ({E})")
def _(spark, d):
    return vectors(spark, d).select("vec_id", digits(V.scalar("multiply", F.col("v"), (F.col("vec_id") % 3).cast("double"))).alias("r"))


@register("vector_clip_where", f"SELECT vec_id, list_transform(v, lambda x: round(greatest(least(x, 0.1), -0.1), 6) + 0.0) AS c, list_transform(v, lambda x: round(CASE WHEN x > 0 THEN x ELSE x * x END, 6) + 0.0) AS w FROM ({E})")
def _(spark, d):
    v = F.col("v")
    return vectors(spark, d).select("vec_id", digits(V.clip(v, -0.1, 0.1)).alias("c"), digits(V.where(F.transform(v, lambda x: (x > 0).cast("int")), v, V.unary("square", v))).alias("w"))


@register(
    "vector_reductions",
    f"SELECT vec_id, round(list_sum(v), 6) AS s, round(list_avg(v), 6) AS m, round(list_min(v), 6) AS lo, round(list_max(v), 6) AS hi, round(list_var_pop(v), 6) AS var, round(list_stddev_pop(v), 6) AS std, list_position(v, list_min(v))::bigint - 1 AS amin, list_position(v, list_max(v))::bigint - 1 AS amax, round(sqrt(list_inner_product(v, v)), 6) AS n2, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS n1, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS ninf FROM ({E})",
)
def _(spark, d):
    v = F.col("v")
    named = {"s": V.total(v), "m": V.mean(v), "lo": F.array_min(v), "hi": F.array_max(v), "var": V.var(v), "std": V.std(v), "n2": V.norm(v), "n1": V.norm(v, "1"), "ninf": V.norm(v, "inf")}
    return vectors(spark, d).select("vec_id", V.argmin(v).alias("amin"), V.argmax(v).alias("amax"), *[F.round(c, 6).alias(n) for n, c in named.items()])


@register("vector_cumulative", f"SELECT vec_id, list_transform(v, lambda x, i: round(list_sum(v[1:i]), 6) + 0.0) AS s, list_transform(v, lambda x, i: round(list_product(list_transform(v[1:i], lambda y: 1 + y)), 6) + 0.0) AS p FROM ({E})")
def _(spark, d):
    return vectors(spark, d).select("vec_id", digits(V.cumulative(F.col("v"))).alias("s"), digits(V.cumulative(F.transform("v", lambda x: 1 + x), "prod")).alias("p"))


@register(
    "vector_softmax",
    f"SELECT vec_id, list_transform(v, lambda x: round(exp(x) / list_sum(list_transform(v, lambda y: exp(y))), 8)) AS s, list_transform(v, lambda x: round(x - ln(list_sum(list_transform(v, lambda y: exp(y)))), 6)) AS l, round(ln(list_sum(list_transform(v, lambda y: exp(y)))), 6) AS z FROM ({E})",
)
def _(spark, d):
    v = F.col("v")
    return vectors(spark, d).select("vec_id", digits(V.softmax(v), 8).alias("s"), digits(V.log_softmax(v)).alias("l"), F.round(V.logsumexp(v), 6).alias("z"))


@register("vector_layer_norm", f"SELECT vec_id, list_transform(v, lambda x: round((x - list_avg(v)) / sqrt(list_var_pop(v) + 1e-5), 5) + 0.0) AS r FROM ({E})")
def _(spark, d):
    return vectors(spark, d).select("vec_id", digits(V.layer_norm(F.col("v")), 5).alias("r"))


@register("vector_linear", f"SELECT vec_id, [round(v[1] - 2 * v[2] + 0.5, 6) + 0.0, round(3 * v[3] + v[1] - 1, 6) + 0.0] AS r FROM ({E})")
def _(spark, d):
    return vectors(spark, d).select("vec_id", digits(V.linear(F.slice("v", 1, 3), [[1, -2, 0], [1, 0, 3]], [0.5, -1.0])).alias("r"))


@register("vector_selection", f"SELECT vec_id, [v[6], v[1], v[6]] AS t, list_filter(v, lambda x: x > 0.1) AS c, v[3:40:7] AS st, list_concat(v[1:2], v[63:64]) AS cat, list_reverse(v) AS rev, [v[1:32], v[33:64]] AS re FROM ({E})")
def _(spark, d):
    v = F.col("v")
    mask = F.transform(v, lambda x: (x > 0.1).cast("int"))
    return vectors(spark, d).select("vec_id", V.take(v, [5, 0, 5]).alias("t"), V.compress(mask, v).alias("c"), V.stride(v, 2, 40, 7).alias("st"), V.concatenate(F.slice(v, 1, 2), F.slice(v, 63, 2)).alias("cat"), F.reverse(v).alias("rev"), V.reshape(v, 32).alias("re"))


@register("ragged_padding", "SELECT user_id, list_concat(v, list_resize([0.0::double], greatest(n - len(v), 0)::bigint, 0.0::double)[1:greatest(n - len(v), 0)::bigint]) AS p FROM (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1), (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM events GROUP BY user_id))")
def _(spark, d):
    x = T(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda r: r["value"]).alias("v"))
    longest = F.broadcast(x.agg(F.max(F.size("v")).alias("n")))  # one row
    return x.join(longest).select("user_id", V.pad(F.col("v"), F.col("n"), 0.0).alias("p"))


@register("constructors", "SELECT [0.0::double, 0.25, 0.5, 0.75, 1.0] AS lin, [1.0::double, 1.5, 2.0] AS ar, [7.0::double, 7.0, 7.0] AS f")
def _(spark, d):
    return spark.range(1).select(V.linspace(0, 1, 5).alias("lin"), V.arange(1, 2.5, 0.5).alias("ar"), F.array_repeat(F.lit(7.0), 3).alias("f"))


ERF = "(sign(x) * (1 - (1 / (1 + 0.3275911 * abs(x))) * (0.254829592 + (1 / (1 + 0.3275911 * abs(x))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs(x))) * (1.421413741 + (1 / (1 + 0.3275911 * abs(x))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs(x))) * 1.061405429)))) * exp(-x * x)))"
CLOSED = {
    "erf": (lambda x: sp.erf(x), ERF),
    "erfc": (lambda x: sp.erfc(x), f"1 - {ERF}"),
    "expit": (lambda x: sp.expit(x), "1 / (1 + exp(-x))"),
    "logit": (lambda x: sp.logit(F.abs(x) / (F.abs(x) + 1)), "CASE WHEN x = 0 THEN '-Infinity'::double ELSE ln((abs(x) / (abs(x) + 1)) / (1 - abs(x) / (abs(x) + 1))) END"),
    "norm_pdf": (lambda x: sp.norm_pdf(x, 0.5, 2.0), "exp(-pow((x - 0.5) / 2, 2) / 2) / (2 * sqrt(2 * pi()))"),
    "norm_cdf": (lambda x: sp.norm_cdf(x), "0.5 * (1 + " + ERF.replace("x", "(x / sqrt(2))").replace("e(x / sqrt(2))p", "exp") + ")"),
    "uniform_pdf": (lambda x: sp.uniform_pdf(x, -1, 3), "CASE WHEN x BETWEEN -1 AND 2 THEN 1 / 3.0 ELSE 0 END"),
    "uniform_cdf": (lambda x: sp.uniform_cdf(x, -1, 3), "least(greatest((x + 1) / 3, 0), 1)"),
    "expon_pdf": (lambda x: sp.expon_pdf(x, 0, 2), "CASE WHEN x < 0 THEN 0 ELSE exp(-x / 2) / 2 END"),
    "expon_cdf": (lambda x: sp.expon_cdf(x, 0, 2), "CASE WHEN x < 0 THEN 0 ELSE 1 - exp(-x / 2) END"),
    "laplace_pdf": (lambda x: sp.laplace_pdf(x), "exp(-abs(x)) / 2"),
    "laplace_cdf": (lambda x: sp.laplace_cdf(x), "CASE WHEN x < 0 THEN exp(x) / 2 ELSE 1 - exp(-x) / 2 END"),
    "logistic_pdf": (lambda x: sp.logistic_pdf(x), "exp(-abs(x)) / pow(1 + exp(-abs(x)), 2)"),
    "logistic_cdf": (lambda x: sp.logistic_cdf(x), "1 / (1 + exp(-x))"),
}
X = "(value - 50) / 20"


def _closed(name, f, sql):
    @register(f"dist_{name}", f"SELECT event_id, round({sql}, 6) AS y FROM (SELECT event_id, {X} AS x FROM events)")
    def _(spark, d):
        x = T(spark, d, "events").select("event_id", ((F.col("value") - 50) / 20).alias("x"))
        return x.select("event_id", F.round(f(F.col("x")), 6).alias("y"))


for name, (f, sql) in CLOSED.items():
    _closed(name, f, sql)
P = "(1 + event_id % 98) / 100.0"
for name, f, sql in (
    ("uniform_ppf", lambda p: sp.uniform_ppf(p, 1, 2), "1 + 2 * p"), ("expon_ppf", lambda p: sp.expon_ppf(p), "-ln(1 - p)"), ("laplace_ppf", lambda p: sp.laplace_ppf(p), "CASE WHEN p < 0.5 THEN ln(2 * p) ELSE -ln(2 * (1 - p)) END"), ("logistic_ppf", lambda p: sp.logistic_ppf(p), "ln(p / (1 - p))"),
):

    def _ppf(name, f, sql):
        @register(f"dist_{name}", f"SELECT event_id, round({sql}, 6) AS y FROM (SELECT event_id, ({P})::double AS p FROM events)")
        def _(spark, d):
            x = T(spark, d, "events").select("event_id", ((F.col("event_id") % 98 + 1) / 100).cast("double").alias("p"))
            return x.select("event_id", F.round(f(F.col("p")), 6).alias("y"))

    _ppf(name, f, sql)

#: Closed forms of the distributions for the parameters below, as SQL of x (or p for quantiles, by halving).
BINOM = "exp(lgamma(21) - lgamma({k} + 1) - lgamma(21 - {k}) + {k} * ln(0.3) + (20 - {k}) * ln(0.7))"
PHI = "(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda n: pow({x}, 2 * n + 1) / exp(lgamma(2 * n + 2) - lgamma(n + 1) - n * ln(2)))))"
T_CDF = "(0.5 + (atan({x} / sqrt(5)) + sin(atan({x} / sqrt(5))) * cos(atan({x} / sqrt(5))) * (1 + 2.0 / 3 * pow(cos(atan({x} / sqrt(5))), 2))) / pi())"
CHI2_CDF = "(1 - exp(-({x}) / 2) * (1 + ({x}) / 2))"
GAMMA_CDF = "(exp(-({x})) * pow({x}, 2.5) * list_sum(list_transform(range(0, 120), lambda n: exp(n * ln(greatest({x}, 1e-300)) - lgamma(n + 3.5)))))"
BETA_CDF = "(6 * pow({x}, 2) - 8 * pow({x}, 3) + 3 * pow({x}, 4))"


def _halved(cdf, low, high):
    """SQL for the point of low..high at which an increasing cdf reaches p, as a list folded over 60 halvings."""
    m = "((a['lo'] + a['hi']) / 2)"
    step = f"CASE WHEN {cdf.format(x=m)} < p THEN {{'lo': {m}, 'hi': a['hi']}} ELSE {{'lo': a['lo'], 'hi': {m}}} END"
    start = f"{{'lo': {low}::double, 'hi': {high}::double}}"
    return f"list_reduce(list_transform(range(0, 61), lambda i: {start}), lambda a, b: {step})['lo']"


KERNEL_SQL = {
    "gamma": "gamma(x)", "gammaln": "lgamma(x)", "i0": "list_sum(list_transform(range(0, 60), lambda n: exp(2 * n * ln(greatest(x / 2, 1e-300)) - 2 * lgamma(n + 1))))",
    "ndtri": _halved(PHI, -9, 9), "norm_ppf": f"1 + 2 * {_halved(PHI, -9, 9)}",
    "t_pdf": "8 / (3 * pi() * sqrt(5) * pow(1 + x * x / 5, 3))", "t_cdf": T_CDF.format(x="x"), "t_ppf": _halved(T_CDF, -60, 60),
    "chi2_pdf": "x / 4 * exp(-x / 2)", "chi2_cdf": CHI2_CDF.format(x="x"), "chi2_ppf": _halved(CHI2_CDF, 0, 100),
    "gamma_pdf": "pow(x, 1.5) * exp(-x) / gamma(2.5)", "gamma_cdf": GAMMA_CDF.format(x="x"), "gamma_ppf": _halved(GAMMA_CDF, 0, 40),
    "beta_pdf": "12 * x * pow(1 - x, 2)", "beta_cdf": BETA_CDF.format(x="x"), "beta_ppf": _halved(BETA_CDF, 0, 1),
    "poisson_pmf": "exp(x * ln(3.0) - 3.0 - lgamma(x + 1))", "poisson_cdf": "list_sum(list_transform(range(0, floor(x)::int + 1), lambda j: exp(j * ln(3.0) - 3.0 - lgamma(j + 1))))",
    "binom_pmf": BINOM.format(k="x"), "binom_cdf": f"list_sum(list_transform(range(0, floor(x)::int + 1), lambda j: {BINOM.format(k='j')}))",
}
KERNELS = {
    "gamma": (), "gammaln": (), "i0": (), "ndtri": (), "norm_ppf": (1.0, 2.0), "t_pdf": (5.0,), "t_cdf": (5.0,), "t_ppf": (5.0,), "chi2_pdf": (4.0,), "chi2_cdf": (4.0,), "chi2_ppf": (4.0,), "gamma_pdf": (2.5,), "gamma_cdf": (2.5,), "gamma_ppf": (2.5,),
    "beta_pdf": (2.0, 3.0), "beta_cdf": (2.0, 3.0), "beta_ppf": (2.0, 3.0), "poisson_pmf": (3.0,), "poisson_cdf": (3.0,), "binom_pmf": (20.0, 0.3), "binom_cdf": (20.0, 0.3),
}


def _kernel(name, parameters):
    def argument(k):
        if name in ("gamma", "gammaln"):
            return 1 + k / 10
        return (k + 1) / 45 if "ppf" in name or name in ("ndtri", "beta_pdf", "beta_cdf") else k / 4 if "p" in name and "mf" not in name or name == "i0" else k

    x = {1: "1 + k / 10.0", 2: "(k + 1) / 45.0", 3: "k / 4.0", 4: "k"}[1 if name in ("gamma", "gammaln") else 2 if "ppf" in name or name in ("ndtri", "beta_pdf", "beta_cdf") else 3 if "p" in name and "mf" not in name or name == "i0" else 4]

    # the 20 arguments are computed once and joined
    @register(f"dist_{name}", f"WITH v AS (SELECT k, round({KERNEL_SQL[name]}, 6) + 0.0 AS y FROM (SELECT k, x, x AS p FROM (SELECT k, ({x})::double AS x FROM range(20) r(k)))) SELECT event_id, y FROM events JOIN v ON event_id % 20 = k")
    def _(spark, d):
        k = (F.col("event_id") % 20).cast("double")
        return T(spark, d, "events").select("event_id", (F.round(sp.kernel(name, *parameters)(argument(k)), 6) + 0.0).alias("y"))


for name, parameters in KERNELS.items():
    _kernel(name, parameters)


MOMENTS = "SELECT count(x) AS n, avg(x) AS m1, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM (SELECT (value - 50) AS x FROM events)"


@register(
    "moments",
    f"SELECT n, round(m1, 5) AS mean, round(v, 5) AS var, round(sqrt(v), 5) AS std, round((m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / pow(v, 1.5), 5) AS skew, round((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * pow(m1, 4)) / (v * v) - 3, 5) AS kurtosis, round(sqrt(v * n / (n - 1)) / sqrt(n), 5) AS sem FROM (SELECT *, m2 - m1 * m1 AS v FROM ({MOMENTS}))",
)
def _(spark, d):
    return rounded(S.moments(T(spark, d, "events").select((F.col("value") - 50).alias("x")), "x"), 5)


@register("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(spark, d):
    return T(spark, d, "lineitem").agg(F.round(S.correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


@register("spearman", "SELECT round(corr(a, b), 6) AS r FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)")
def _(spark, d):
    r, _ = S.spearmanr(T(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return spark.createDataFrame([(round(r, 6),)], "r double")


@register(
    "ttest",
    "WITH g AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_tax) AS m, var_samp(l_tax) AS v FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1) SELECT round((a.m - r.m) / sqrt(((a.n - 1) * a.v + (r.n - 1) * r.v) / (a.n + r.n - 2) * (1.0 / a.n + 1.0 / r.n)), 6) AS t FROM g a, g r WHERE a.f = 'A' AND r.f = 'R'",
)
def _(spark, d):
    t, _ = S.ttest_ind(T(spark, d, "lineitem"), "l_tax", "l_returnflag", "A", "R")
    return spark.createDataFrame([(round(t, 6),)], "t double")


@register("entropy", "SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT c / sum(c) OVER () AS p FROM (SELECT count(*)::double AS c FROM events GROUP BY event_type))")
def _(spark, d):
    return rounded(S.entropy(T(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("c")), "c"))


@register("logsumexp", "SELECT round(ln(sum(exp(value - 100))) + 100, 6) AS logsumexp FROM events")
def _(spark, d):
    return rounded(S.logsumexp(T(spark, d, "events"), "value"))


Q = "SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events"


@register("trapezoid", f"SELECT user_id, round(coalesce(sum((value + p) / 2 * 0.5), 0), 4) AS area FROM ({Q}) GROUP BY 1")
def _(spark, d):
    return rounded(S.trapezoid(T(spark, d, "events"), "value", "event_id", ["user_id"], 0.5), 4)


@register("cumulative_trapezoid", f"SELECT user_id, event_id, round(sum(coalesce((value + p) / 2, 0)) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS area FROM ({Q})")
def _(spark, d):
    return rounded(S.cumulative_trapezoid(T(spark, d, "events"), "value", "event_id", ["user_id"]).select("user_id", "event_id", "area"), 4)


@register(
    "simpson",
    "WITH r AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(sum(y * (CASE WHEN i >= m OR m < 3 THEN 0 WHEN i = 0 OR i = m - 1 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 3.0 + CASE WHEN n % 2 = 1 OR n < 3 THEN 0 WHEN i = n - 1 THEN 5 WHEN i = n - 2 THEN 8 WHEN i = n - 3 THEN -1 ELSE 0 END / 12.0 + CASE WHEN n = 2 THEN 0.5 ELSE 0 END)), 4) AS area FROM (SELECT *, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END AS m FROM r) GROUP BY 1",
)
def _(spark, d):
    return rounded(S.simpson(T(spark, d, "events"), "value", "event_id", ["user_id"]), 4)


@register(
    "classification_metrics",
    "WITH c AS (SELECT count(*) FILTER (t = 1 AND g = 1) AS b, count(*) FILTER (t = 1) AS pt, count(*) FILTER (g = 1) AS pg, count(*) FILTER (t = g) AS ok, count(*) AS n FROM (SELECT quality AS t, toxic AS g FROM labels)) SELECT ok / n AS accuracy, coalesce(b / nullif(pg, 0), 0) AS precision, coalesce(b / nullif(pt, 0), 0) AS recall, coalesce(2 * b / nullif(pt + pg, 0), 0) AS f1 FROM c",
)
def _(spark, d):
    return S.classification(T(spark, d, "labels"), "quality", "toxic")


@register("regression_metrics", "SELECT round(avg(pow(t - g, 2)), 5) AS mse, round(avg(abs(t - g)), 5) AS mae, round(1 - sum(pow(t - g, 2)) / (var_pop(t) * count(*)), 5) AS r2 FROM (SELECT l_extendedprice / 1000 AS t, l_quantity AS g FROM lineitem)")
def _(spark, d):
    x = T(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("t"), F.col("l_quantity").alias("g"))
    return rounded(S.regression(x, "t", "g"), 5)


COO = f"SELECT vec_id AS i, generate_subscripts(v, 1) - 1 AS j, unnest(v) AS v FROM ({E})"


def coo(spark, d):
    return M.from_vectors(T(spark, d, "embeddings"), "vec_id", "embedding")


@register("coo_gram", f"SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM ({COO}) a JOIN ({COO}) b ON a.i = b.i GROUP BY 1, 2")
def _(spark, d):
    return rounded(M.gram(coo(spark, d)))


@register("coo_matmul", f"SELECT a.i AS i, b.i AS j, round(sum(a.v * b.v), 6) AS v FROM ({COO}) a JOIN ({COO}) b ON a.j = b.j GROUP BY 1, 2")
def _(spark, d):
    m = coo(spark, d)
    return rounded(M.matmul(m, M.transpose(m)))


@register("coo_matvec", f"SELECT i, round(sum(v * (j + 1)), 6) AS v FROM ({COO}) GROUP BY 1")
def _(spark, d):
    return rounded(M.matvec(coo(spark, d), spark.range(64).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v"))))


@register("coo_sparse_add", f"SELECT i, j, round(sum(v), 6) AS v FROM (SELECT i, j, v FROM ({COO}) WHERE v <> 0 AND abs(v) >= 0.2 UNION ALL SELECT i, j, v * 2 FROM ({COO}) WHERE v > 0.1) GROUP BY 1, 2")
def _(spark, d):
    return rounded(M.add(M.sparse(coo(spark, d), 0.2), M.scale(coo(spark, d).where("v > 0.1"), 2.0)))


@register("coo_norms", f"SELECT (SELECT round(sqrt(sum(v * v)), 6) FROM ({COO})) AS fro, (SELECT round(max(s), 6) FROM (SELECT sum(abs(v)) AS s FROM ({COO}) GROUP BY j)) AS one, (SELECT round(max(s), 6) FROM (SELECT sum(abs(v)) AS s FROM ({COO}) GROUP BY i)) AS inf, (SELECT round(sum(v), 6) FROM ({COO}) WHERE i = j) AS tr")
def _(spark, d):
    m = coo(spark, d)
    out = M.norm(m).toDF("fro").join(M.norm(m, "1").toDF("one")).join(M.norm(m, "inf").toDF("inf")).join(M.trace(m).toDF("tr"))  # one row each
    return rounded(out)


def _axis(what, axis, f):
    @register(f"coo_axis_{what}" + ("_rows" if axis else ""), f"SELECT {'i' if axis else 'j'}, round({f}(v), 6) AS v FROM ({COO}) GROUP BY 1")
    def _(spark, d):
        return rounded(M.reduce_axis(coo(spark, d), axis, what))


for what, f in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max")):
    _axis(what, 0, f)
    _axis(what, 1, f)


@register("coo_roundtrip", "SELECT vec_id AS i, list_transform(embedding, lambda x: x::double) AS v FROM embeddings")
def _(spark, d):
    return M.to_vectors(coo(spark, d), 64)


@register("singular_values", None)
def _(spark, d):
    return spark.createDataFrame([(i, float(round(s, 6))) for i, s in enumerate(M.singular_values(T(spark, d, "embeddings"), "embedding"))], "i long, s double")


@register("tall_qr_reconstruction", f"SELECT i, j, round(v, 5) + 0.0 AS v FROM ({COO})")
def _(spark, d):
    q, r = M.tall_qr(T(spark, d, "embeddings"), "vec_id", "embedding")
    return M.matmul(M.from_vectors(q, "vec_id", "q"), M.cells(spark, r)).select("i", "j", (F.round("v", 5) + 0.0).alias("v"))


@register("spsolve_product", "SELECT i, 1.0::double AS v FROM range(64) t(i)")
def _(spark, d):
    a = M.add(M.gram(coo(spark, d)), M.eye(spark, 64))
    x = M.spsolve(a, spark.range(64).select(F.col("id").alias("i"), F.lit(1.0).alias("v")))
    return rounded(M.matvec(a, x))


@register("conjugate_gradient", None)
def _(spark, d):
    from colframe.sources.scratch import shared_dir

    shared_dir(spark)
    a = M.add(M.gram(coo(spark, d)), M.eye(spark, 64))
    return rounded(M.conjugate_gradient(a, spark.range(64).select(F.col("id").alias("i"), F.lit(1.0).alias("v")), steps=15), 4)


# --- shapes: embeddings as arrays of shape (4, 4, 4) or (8, 8)


@register("shape_moves", f"SELECT vec_id, list_transform(range(0, 64), lambda i: v[(i % 4) * 16 + i // 4 + 1]) AS moved, list_transform(range(0, 64), lambda i: v[(i // 16) * 16 + (i % 4) * 4 + (i // 4 % 4) + 1]) AS swapped, list_transform(range(0, 16), lambda i: v[(i // 4) * 16 + 8 + i % 4 + 1]) AS part, list_transform(range(0, 8), lambda i: v[(1 + i // 4) * 16 + (i // 2 % 2) * 8 + (i % 2) * 3 + 1]) AS cut FROM ({E})")
def _(spark, d):
    v, shape = F.col("v"), (4, 4, 4)
    out = {"moved": H.moveaxis(v, shape, 0, 2)[0], "swapped": H.swapaxes(v, shape, 1, 2)[0], "part": H.index_axis(v, shape, 1, 2)[0], "cut": H.slice_axes(v, shape, [slice(1, 3), slice(0, 4, 2), slice(0, 4, 3)])[0]}
    return vectors(spark, d).select("vec_id", *[c.alias(n) for n, c in out.items()])


@register("shape_joins", f"SELECT vec_id, list_transform(range(0, 8), lambda i: v[(i % 2) * 4 + i // 2 + 1]) AS stacked, list_transform(range(0, 12), lambda i: v[i // 4 + 1]) AS wide, [v[10], v[1], v[64]] AS points, list_transform(range(0, 8), lambda i: v[8 * i + (vec_id + i) % 8 + 1]) AS along FROM ({E})")
def _(spark, d):
    v = F.col("v")
    index = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("vec_id") + i) % 8)
    out = {
        "stacked": H.stack([F.slice(v, 1, 4), F.slice(v, 5, 4)], (4,), 1)[0],
        "wide": H.broadcast_to(F.slice(v, 1, 3), (3, 1), (3, 4))[0],
        "points": H.fancy_index_2d(v, (8, 8), [1, 0, 7], [1, 0, 7]),
        "along": H.take_along_axis(v, (8, 8), index, 1, 1)[0],
    }
    return vectors(spark, d).select("vec_id", *[c.alias(n) for n, c in out.items()])


@register("batched_matmul", f"SELECT vec_id, list_transform(range(0, 8), lambda c: round(list_sum(list_transform(range(0, 3), lambda k: v[((c // 4) * 2 + c // 2 % 2) * 3 + k + 1] * v[20 + ((c // 4) * 3 + k) * 2 + c % 2 + 1])), 6) + 0.0) AS r FROM ({E})")
def _(spark, d):
    v = F.col("v")
    return vectors(spark, d).select("vec_id", digits(H.bmm(F.slice(v, 1, 12), F.slice(v, 21, 12), 2, 2, 3, 2)).alias("r"))


@register("casts", f"SELECT vec_id, list_transform(v, lambda x: trunc(x * 10)::bigint) AS l, list_transform(v, lambda x: x::float::double) AS f, list_transform(v, lambda x: x <> 0) AS b FROM ({E})")
def _(spark, d):
    v = F.col("v")
    return vectors(spark, d).select("vec_id", H.astype(F.transform(v, lambda x: x * 10), "long").alias("l"), H.astype(H.astype(v, "float"), "double").alias("f"), H.astype(v, "boolean").alias("b"))


@register("same_bits", "SELECT event_id, event_id % 4 <> 1 AS same FROM events")
def _(spark, d):
    k = F.col("event_id") % 4
    a = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(0.0)).otherwise(F.col("value"))
    b = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(-0.0)).otherwise(F.col("value"))
    return T(spark, d, "events").select("event_id", H.same_bits(a, b).alias("same"))


@register("randn", f"WITH RECURSIVE s(i, x) AS (SELECT 1, (42 * 1664525::hugeint + 1013904223) % 18446744073709551616::hugeint UNION ALL SELECT i + 1, (x * 1664525 + 1013904223) % 18446744073709551616::hugeint FROM s WHERE i < 100), u AS (SELECT i, (x // 256) % 16777216 / 16777216.0 AS u FROM s) SELECT (a.i - 1 + j)::int AS i, round(sqrt(-2 * ln(greatest(a.u, 1e-7))) * CASE WHEN j = 0 THEN cos(2 * pi() * b.u) ELSE sin(2 * pi() * b.u) END, 6) + 0.0 AS x FROM u a JOIN u b ON b.i = a.i + 1 AND a.i % 2 = 1, range(2) t(j)")
def _(spark, d):
    return spark.createDataFrame([(i, round(float(x), 6) + 0.0) for i, x in enumerate(N.lcg_normal(100, 42))], "i int, x double")


# --- a small matrix a row: m general, s = m m^T + 1 positive definite, y a right side

SMALL = "SELECT vec_id, v[1] AS a, v[2] AS b, v[3] AS c, v[4] AS d, v[5] AS y1, v[6] AS y2, v[1] * v[1] + v[2] * v[2] + 1 AS p, v[1] * v[3] + v[2] * v[4] AS q, v[3] * v[3] + v[4] * v[4] + 1 AS r FROM (SELECT vec_id, embedding::double[] AS v FROM embeddings)"


def small(spark, d):
    v = vectors(spark, d).select("vec_id", F.slice("v", 1, 4).alias("m"), F.slice("v", 5, 2).alias("y"))
    a, b, c, e = (F.get("m", F.lit(i)) for i in range(4))
    return v.withColumn("s", F.array(a * a + b * b + 1, a * c + b * e, a * c + b * e, c * c + e * e + 1))


@register("dense_solve", f"SELECT vec_id, [round(p * r - q * q, 6)] AS det, list_transform([r / (p * r - q * q), -q / (p * r - q * q), -q / (p * r - q * q), p / (p * r - q * q)], lambda x: round(x, 6) + 0.0) AS inv, list_transform([(r * y1 - q * y2) / (p * r - q * q), (p * y2 - q * y1) / (p * r - q * q)], lambda x: round(x, 6) + 0.0) AS x, list_transform([y1 / p, (y2 - q * y1 / p) / r], lambda x: round(x, 6) + 0.0) AS low, list_transform([(y1 - q * y2 / r) / p, y2 / r], lambda x: round(x, 6) + 0.0) AS up FROM ({SMALL})")
def _(spark, d):
    s, y = F.col("s"), F.col("y")
    out = {"det": B.apply("det", (2, 2), s), "inv": B.apply("inv", (2, 2), s), "x": B.apply("solve", (2, 2), s, y), "low": B.apply("solve_lower", (2, 2), s, y), "up": B.apply("solve_upper", (2, 2), s, y)}
    return small(spark, d).select("vec_id", *[digits(c).alias(n) for n, c in out.items()])


@register(
    "dense_factors",
    f"SELECT vec_id, list_transform([sqrt(p), 0, q / sqrt(p), sqrt(r - q * q / p)], lambda x: round(x, 6) + 0.0) AS chol, list_transform([m - h, m + h], lambda x: round(x, 6) + 0.0) AS eig, list_transform([sqrt(t + sqrt(t * t - z * z)), sqrt(greatest(t - sqrt(greatest(t * t - z * z, 0)), 0))], lambda x: round(x, 5) + 0.0) AS sv, list_transform(CASE WHEN h = 0 THEN [exp(m), 0, 0, exp(m)] ELSE list_transform([cosh(h) + sinh(h) / h * (p - m), sinh(h) / h * q, sinh(h) / h * q, cosh(h) + sinh(h) / h * (r - m)], lambda x: exp(m) * x) END, lambda x: round(x, 5) + 0.0) AS e, list_transform(CASE WHEN abs(c) > abs(a) THEN [c, d, 0, b - a / c * d] ELSE [a, b, 0, d - c / a * b] END, lambda x: round(x, 5) + 0.0) AS u FROM (SELECT *, (p + r) / 2 AS m, sqrt((p - r) * (p - r) / 4 + q * q) AS h, (a * a + b * b + c * c + d * d) / 2 AS t, a * d - b * c AS z FROM ({SMALL}))",
)
def _(spark, d):
    s, m = F.col("s"), F.col("m")
    return small(spark, d).select(
        "vec_id",
        digits(B.apply("cholesky", (2, 2), s)).alias("chol"),
        digits(B.apply("eigvalsh", (2, 2), s)).alias("eig"),
        digits(B.apply("svdvals", (2, 2), m), 5).alias("sv"),
        digits(B.apply("expm", (2, 2), s), 5).alias("e"),
        digits(B.apply("lu_u", (2, 2), m), 5).alias("u"),
    )


@register("dense_products", f"SELECT vec_id, list_transform([a, b, c, d], lambda x: round(x, 6) + 0.0) AS qr, list_transform([a, b, c, d], lambda x: round(x, 6) + 0.0) AS lu FROM ({SMALL})")
def _(spark, d):
    """q r and p l u give the matrix back."""
    m = F.col("m")
    part = lambda what: B.apply(what, (2, 2), m)
    parts = small(spark, d).select("vec_id", *[part(x).alias(x) for x in ("qr_q", "qr_r", "lu_p", "lu_l", "lu_u")])
    product = lambda a, b: H.bmm(a, b, 1, 2, 2, 2)
    return parts.select("vec_id", digits(product(F.col("qr_q"), F.col("qr_r"))).alias("qr"), digits(product(product(F.col("lu_p"), F.col("lu_l")), F.col("lu_u"))).alias("lu"))


@register("fft2", f"SELECT vec_id, list_transform(range(0, 64), lambda k: round(list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * cos(2 * pi() * ((i // 8) * (k // 8) + (i % 8) * (k % 8)) / 8))), 5) + 0.0) AS re, list_transform(range(0, 64), lambda k: round(-list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * sin(2 * pi() * ((i // 8) * (k // 8) + (i % 8) * (k % 8)) / 8))), 5) + 0.0) AS im FROM ({E})")
def _(spark, d):
    return vectors(spark, d).select("vec_id", *[digits(B.apply(f"fft2_{x}", (8, 8), F.col("v")), 5).alias(x) for x in ("re", "im")])


def _squares(batch, w):
    """Sum of (x w - y)^2 of a batch of rows."""
    x, y = batch
    e = A.Tensor(x) @ w - y
    return (e * e).sum()


@register("autograd_gradient", "SELECT j::int AS j, round(sum(2 * (embedding[1]::double * 0.5 - embedding[2]::double * 0.25 + embedding[3]::double - label) * embedding[j + 1]::double), 5) + 0.0 AS g FROM embeddings, range(3) t(j) GROUP BY 1")
def _(spark, d):
    e = T(spark, d, "embeddings").select(F.slice("embedding", 1, 3).cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    _, (g,) = A.gradient(e, ["x", "y"], _squares, [np.array([0.5, -0.25, 1.0])])
    return spark.createDataFrame([(j, round(float(v), 5) + 0.0) for j, v in enumerate(g)], "j int, g double")
