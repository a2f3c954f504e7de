"""Queries over the frame operators: filters, joins, aggregates, sorting, reshaping, time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from colframe.functions import cleaning as C
from colframe.operators import frames as fr
from colframe.operators import reshape as rs
from colframe.operators import timeseries as ts
from colframe.plans.catalog import register


def T(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@register("select_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(spark, d):
    return fr.select(T(spark, d, "lineitem"), ["l_orderkey", "l_quantity"])


@register("rename_drop_with_columns", "SELECT n_nationkey AS k, upper(n_name) AS n_name, n_nationkey * 2 AS twice FROM nation")
def _(spark, d):
    df = fr.rename(T(spark, d, "nation"), {"n_nationkey": "k"}).drop("n_regionkey")
    return fr.with_columns(df, {"n_name": F.upper("n_name"), "twice": F.col("k") * 2})


@register("filter_gt", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25 AND NOT isnan(l_quantity)")
def _(spark, d):
    return fr.filter_gt(T(spark, d, "lineitem"), "l_quantity", 25.0).select("l_orderkey", "l_linenumber", "l_quantity")


@register("filter_expression", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity >= 10 AND l_discount < 0.05) OR (l_returnflag = 'R' AND l_tax <> 0.0)")
def _(spark, d):
    x = T(spark, d, "lineitem")
    return x.filter(((F.col("l_quantity") >= 10) & (F.col("l_discount") < 0.05)) | ((F.col("l_returnflag") == "R") & (F.col("l_tax") != 0.0))).select("l_orderkey", "l_linenumber")


@register("mask_column", "SELECT event_id, coalesce(value > 50, false) AS big FROM events")
def _(spark, d):
    return T(spark, d, "events").select("event_id", C.definite(F.col("value") > 50).alias("big"))


HOLES = "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id FROM events"


def holes(spark, d):
    x = T(spark, d, "events")
    return x.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"))


@register("dropna_any", f"SELECT * FROM ({HOLES}) WHERE value IS NOT NULL AND user_id IS NOT NULL")
def _(spark, d):
    return fr.dropna(holes(spark, d), "any")


@register("dropna_all", f"SELECT value, user_id FROM ({HOLES}) WHERE value IS NOT NULL OR user_id IS NOT NULL")
def _(spark, d):
    return fr.dropna(holes(spark, d).drop("event_id"), "all")


@register("fillna", f"SELECT event_id, coalesce(value, 2.5) AS value, coalesce(user_id, 2) AS user_id FROM ({HOLES})")
def _(spark, d):
    return fr.fillna(holes(spark, d), 2.5)


@register("checksum", "SELECT count(*) + 4 + sum(s_suppkey) + sum(octet_length(encode(s_name))) + sum(s_nationkey) + sum(s_acctbal::decimal(18,2))::double AS checksum FROM supplier")
def _(spark, d):
    return rounded(fr.checksum(T(spark, d, "supplier")))


KEYS = "SELECT o_orderkey AS k, o_custkey, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0"
LINES = "SELECT l_orderkey AS k, l_linenumber, l_quantity AS v FROM lineitem WHERE l_orderkey % 2 = 0"


def _merge(how, sql):
    @register(f"merge_{how}", f"SELECT coalesce(a.k, b.k) AS k, o_custkey, a.v AS v_x, l_linenumber, b.v AS v_y FROM ({KEYS}) a {sql} JOIN ({LINES}) b ON a.k IS NOT DISTINCT FROM b.k")
    def _(spark, d):
        a = T(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_totalprice").alias("v"))
        b = T(spark, d, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_quantity").alias("v"))
        return fr.merge(a, b, "k", how)


for how, sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _merge(how, sql)


@register("merge_null_keys", f"SELECT a.user_id, a.event_id, b.first, b.n FROM ({HOLES}) a JOIN (SELECT user_id, min(event_id) AS first, count(*) AS n FROM ({HOLES}) GROUP BY 1) b ON a.user_id IS NOT DISTINCT FROM b.user_id")
def _(spark, d):
    x = holes(spark, d)
    users = x.groupBy("user_id").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))
    return fr.merge(x.select("user_id", "event_id"), users, "user_id", "inner")


@register(
    "merge_two_keys",
    "SELECT a.p AS p, a.s AS s, a.q AS q_x, b.q AS q_y FROM (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) a JOIN (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b USING (p, s)",
)
def _(spark, d):
    def side(flag):
        x = T(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
        return x.groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.sum("l_quantity").alias("q"))

    return fr.merge(side("A"), side("R"), ["p", "s"])


@register("join_left_suffix", "SELECT n_regionkey, n_nationkey, n_name AS name, r_name AS name_right FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    n = fr.rename(T(spark, d, "nation"), {"n_name": "name"})
    r = fr.rename(T(spark, d, "region"), {"r_regionkey": "n_regionkey", "r_name": "name"})
    return fr.join(n, r, "n_regionkey", "left")


@register("join_inner", "SELECT o_custkey, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def _(spark, d):
    o = fr.rename(T(spark, d, "orders").select("o_custkey"), {"o_custkey": "k"})
    c = fr.rename(T(spark, d, "customer").select("c_custkey", "c_mktsegment"), {"c_custkey": "k"})
    return fr.rename(fr.join(o, c, "k").groupBy("k", "c_mktsegment").agg(F.count("*").alias("n")), {"k": "o_custkey"})


def _groups(what):
    sql = {"sum": "round(coalesce(sum(l_extendedprice), 0), 4)", "mean": "round(avg(l_extendedprice), 4)", "count": "count(l_extendedprice)::double", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)"}[what]

    @register(f"groupby_{what}", f"SELECT l_returnflag, {sql} AS l_extendedprice_{what} FROM lineitem GROUP BY 1")
    def _(spark, d):
        return rounded(fr.group(T(spark, d, "lineitem"), "l_returnflag", [("l_extendedprice", what)]), 4)


for what in ("sum", "mean", "count", "min", "max"):
    _groups(what)


@register(
    "groupby_missing_keys",
    f"SELECT user_id, coalesce(round(sum(value), 4), 0) AS value_sum, count(value)::double AS value_count, round(avg(value), 6) AS value_mean FROM ({HOLES}) GROUP BY 1",
)
def _(spark, d):
    out = fr.group(holes(spark, d), "user_id", [("value", "sum"), ("value", "count"), ("value", "mean"), ("user_id", "sum")])
    return out.select("user_id", F.round("value_sum", 4).alias("value_sum"), "value_count", F.round("value_mean", 6).alias("value_mean"))


@register(
    "groupby_multi_key",
    "SELECT l_returnflag, l_linestatus, sum(l_linenumber)::bigint AS l_linenumber_sum, count(l_linenumber) AS l_linenumber_count, min(l_partkey) AS l_partkey_min, max(l_partkey) AS l_partkey_max, round(avg(l_tax), 6) AS l_tax_mean FROM lineitem GROUP BY 1, 2",
)
def _(spark, d):
    aggs = [("l_linenumber", "sum"), ("l_linenumber", "count"), ("l_partkey", "min"), ("l_partkey", "max"), ("l_tax", "mean")]
    return rounded(fr.group(T(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], aggs, "null"))


@register("lazy_filter_group", "SELECT event_type, count(value) AS value_count, round(sum(value), 4) AS value_sum FROM events WHERE value > 10 GROUP BY 1")
def _(spark, d):
    return rounded(fr.group(T(spark, d, "events").filter(F.col("value") > 10), "event_type", [("value", "count"), ("value", "sum")], "null"), 4)


@register("frame_sum", "SELECT sum(p_partkey)::double AS p_partkey, sum(p_size)::double AS p_size, round(sum(p_retailprice), 2) AS p_retailprice FROM part")
def _(spark, d):
    return rounded(fr.reduce_all(T(spark, d, "part"), "sum"), 2)


@register("frame_mean", "SELECT avg(p_partkey) AS p_partkey, round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), 6) AS p_retailprice FROM part")
def _(spark, d):
    return rounded(fr.reduce_all(T(spark, d, "part"), "mean"))


def _describe_sql():
    stats = ["count({0})::double", "avg({0})", "stddev_samp({0})", "min({0})", "quantile_cont({0}, 0.25)", "quantile_cont({0}, 0.5)", "quantile_cont({0}, 0.75)", "max({0})"]
    rows = [f"SELECT '{n}' AS statistic, " + ", ".join(f"round({s.format(c)}, 4) AS {c}" for c in ("l_quantity", "l_discount")) + " FROM lineitem" for n, s in zip(fr.STATISTICS, stats)]
    return " UNION ALL ".join(rows)


@register("describe", _describe_sql())
def _(spark, d):
    return rounded(fr.describe(T(spark, d, "lineitem").select("l_quantity", "l_discount"), "statistic"), 4)


@register("sort_head", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def _(spark, d):
    x = T(spark, d, "lineitem")
    return x.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@register("sort_missing_last", f"SELECT event_id, value, user_id FROM ({HOLES}) ORDER BY value NULLS LAST, event_id")
def _(spark, d):
    return fr.sort_values(holes(spark, d), "value", True, "event_id")


@register("sort_missing_first_desc", f"SELECT event_id, value FROM ({HOLES}) ORDER BY value DESC NULLS FIRST, event_id")
def _(spark, d):
    return fr.sort_values(holes(spark, d).select("event_id", "value"), "value", False, "event_id")


@register("head", "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 7")
def _(spark, d):
    return fr.head(T(spark, d, "supplier"), 7, "s_suppkey")


@register("tail", "SELECT * FROM supplier ORDER BY s_suppkey DESC LIMIT 7")
def _(spark, d):
    return fr.tail(T(spark, d, "supplier"), 7, "s_suppkey")


@register("slice_negative", "SELECT * FROM part ORDER BY p_partkey LIMIT 10 OFFSET (SELECT count(*) - 30 FROM part)")
def _(spark, d):
    return fr.slice_rows(T(spark, d, "part"), -30, 10, "p_partkey")


@register("take_rows", "SELECT i, s.* FROM (SELECT unnest([5, 3, 3, 0]) AS pos, generate_subscripts([5, 3, 3, 0], 1) - 1 AS i) JOIN supplier s ON s_suppkey = pos")
def _(spark, d):
    at = spark.createDataFrame([(5, 0), (3, 1), (3, 2), (0, 3)], "at long, i long")
    return fr.take_rows(T(spark, d, "supplier"), at, "s_suppkey")


@register("melt", "SELECT p_partkey, variable, value FROM (SELECT p_partkey, p_size::double AS p_size, p_retailprice FROM part) UNPIVOT (value FOR variable IN (p_size, p_retailprice))")
def _(spark, d):
    return rs.melt(T(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"])


@register("melt_text", "SELECT n_nationkey, variable, value FROM (SELECT n_nationkey, n_name, n_regionkey::varchar AS n_regionkey FROM nation) UNPIVOT (value FOR variable IN (n_name, n_regionkey))")
def _(spark, d):
    return rs.melt(T(spark, d, "nation"), ["n_nationkey"])


def _pivot(agg):
    f = {"sum": "coalesce(round(sum(CASE WHEN l_linestatus = '{0}' THEN l_tax END), 4), 0.0)", "mean": "round(avg(CASE WHEN l_linestatus = '{0}' THEN l_tax END), 6)", "count": "count(CASE WHEN l_linestatus = '{0}' THEN l_tax END)::double", "min": "min(CASE WHEN l_linestatus = '{0}' THEN l_tax END)", "max": "max(CASE WHEN l_linestatus = '{0}' THEN l_tax END)"}[agg]

    @register(f"pivot_{agg}", "SELECT l_returnflag, " + ", ".join(f"{f.format(x)} AS {x}" for x in "FO") + " FROM lineitem GROUP BY 1")
    def _(spark, d):
        return rounded(rs.pivot_table(T(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_tax", agg, ["F", "O"]), 6 if agg == "mean" else 4)


for agg in ("sum", "mean", "count", "min", "max"):
    _pivot(agg)


@register("categorical_codes", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::bigint AS code FROM orders")
def _(spark, d):
    return rs.categorical_codes(T(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code")


@register("categorical_decode", "SELECT o_orderkey, o_orderpriority AS back FROM orders")
def _(spark, d):
    x = T(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return rs.decode(rs.categorical_codes(x, "o_orderpriority"), rs.categories(x, "o_orderpriority"), "code", "back").select("o_orderkey", "back")


def _rolling(what):
    sql = {"mean": "avg", "sum": "sum"}[what]

    @register(
        f"rolling_{what}",
        f"SELECT event_id, user_id, round(CASE WHEN count(value) OVER w >= 5 THEN {sql}(value) OVER w END, 6) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    )
    def _(spark, d):
        x = T(spark, d, "events")
        return x.select("event_id", "user_id", F.round(ts.rolling(x, "value", 5, what, ["ts", "event_id"], ["user_id"]), 6).alias("r"))


_rolling("mean")
_rolling("sum")


@register(
    "rolling_mean_frame",
    f"SELECT event_id, value, user_id, round(CASE WHEN count(value) OVER w >= 6 THEN avg(value) OVER w END, 6) AS value_mean, round(CASE WHEN count(user_id) OVER w >= 6 THEN avg(user_id) OVER w END, 6) AS user_id_mean FROM ({HOLES}) WINDOW w AS (ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
)
def _(spark, d):
    out = ts.rolling_blocks(holes(spark, d), ["value", "user_id"], 6, "mean", "event_id", 1024)
    return out.withColumns({c: F.round(c, 6) for c in ("value_mean", "user_id_mean")})


def _resample(freq, unit, what):
    value = "round(avg(value), 6)" if what == "mean" else "round(coalesce(sum(value), 0), 4)"
    sql = f"""WITH b AS (SELECT date_trunc('{unit}', ts) AS ts, value FROM events),
      s AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 1 {unit})) AS ts)
      SELECT s.ts, {value} AS value FROM s LEFT JOIN b ON s.ts = b.ts GROUP BY 1"""

    @register(f"resample_{freq}_{what}", sql)
    def _(spark, d):
        return rounded(ts.resample(T(spark, d, "events").select("ts", "value"), "ts", freq, what), 6 if what == "mean" else 4)


for freq, unit in (("h", "hour"), ("D", "day")):
    for what in ("mean", "sum"):
        _resample(freq, unit, what)


@register("date_range", "SELECT TIMESTAMP '2024-01-01 05:00:00' + INTERVAL (i) hour AS ts FROM range(48) t(i)")
def _(spark, d):
    return ts.date_range(spark, "2024-01-01 05:00:00", 48, "h")


@register("floor_bin", "SELECT event_id, date_trunc('hour', ts) AS bin FROM events")
def _(spark, d):
    return T(spark, d, "events").select("event_id", ts.floor_bin("ts", "h").alias("bin"))


@register("cumsum", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 4) AS total, row_number() OVER (ORDER BY event_id) AS n FROM events")
def _(spark, d):
    out = fr.running(T(spark, d, "events").select("event_id", "value"), "event_id", total="sum:value", n="count")
    return out.select("event_id", F.round("total", 4).alias("total"), F.col("n").cast("bigint").alias("n"))


@register("cumprod", "SELECT event_id, round(product(1 + value / 1e7) OVER (ORDER BY event_id), 6) AS p FROM events")
def _(spark, d):
    x = T(spark, d, "events").select("event_id", (1 + F.col("value") / 1e7).alias("x"))
    return fr.running(x, "event_id", p="prod:x").select("event_id", F.round("p", 6).alias("p"))


@register("cumsum_axis", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM events")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return T(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("total"))


@register("rankdata", "SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events")
def _(spark, d):
    return fr.rankdata(T(spark, d, "events").select("event_id", "value"), "value", "r").select("event_id", "r")


@register("zscore", "SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS z FROM supplier")
def _(spark, d):
    x = T(spark, d, "supplier")
    m = F.broadcast(x.agg(F.avg("s_acctbal").alias("m"), F.stddev_pop("s_acctbal").alias("s")))  # one row
    return x.join(m).select("s_suppkey", F.round((F.col("s_acctbal") - F.col("m")) / F.col("s"), 6).alias("z"))


@register("where_clip_round", "SELECT event_id, CASE WHEN value > 50 THEN value ELSE -value END AS w, greatest(least(value, 80), 20) AS c, round(value, 0) AS r, trunc(value) AS t, sign(value - 50)::double AS s FROM events")
def _(spark, d):
    v = F.col("value")
    return T(spark, d, "events").select(
        "event_id", F.when(v > 50, v).otherwise(-v).alias("w"), F.greatest(F.least(v, F.lit(80.0)), F.lit(20.0)).alias("c"), C.round_away(v).alias("r"), C.truncate(v).alias("t"), F.signum(v - 50).alias("s")
    )


@register("ieee_arithmetic", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Infinity'::double ELSE value / (event_id % 3) END AS q, CASE WHEN event_id % 3 = 0 THEN '-Infinity'::double ELSE round(ln(event_id % 3), 6) END AS l FROM events WHERE value > 0")
def _(spark, d):
    m = (F.col("event_id") % 3).cast("double")
    return T(spark, d, "events").where("value > 0").select("event_id", C.ieee_divide(F.col("value"), m).alias("q"), F.round(C.ieee_log(m), 6).alias("l"))


SHAPE = "SELECT o_orderpriority, count(*) AS l_extendedprice_count, round(sum(l_extendedprice), 4) AS l_extendedprice_sum, round(avg(l_extendedprice), 4) AS l_extendedprice_mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25 GROUP BY 1"


@register("flagship", SHAPE)
def flagship(spark, d):
    lines = fr.filter_gt(T(spark, d, "lineitem"), "l_quantity", 25.0).select(F.col("l_orderkey").alias("k"), "l_extendedprice")
    both = fr.merge(lines, T(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority"), "k")
    out = fr.group(both, "o_orderpriority", [("l_extendedprice", "sum"), ("l_extendedprice", "mean"), ("l_extendedprice", "count")])
    return rounded(out.withColumn("l_extendedprice_count", F.col("l_extendedprice_count").cast("bigint")), 4)


@register("map_values", f"SELECT event_id, round(sin(value) * 2 + 1, 6) AS value FROM ({HOLES})")
def _(spark, d):
    import numpy as np

    return rounded(fr.map_values(holes(spark, d).select("event_id", "value"), "value", lambda x: np.sin(x) * 2 + 1))


@register("apply_values", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.04 THEN 1 ELSE l_tax * l_tax END::double AS l_tax FROM lineitem")
def _(spark, d):
    return fr.apply_values(T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), "l_tax", lambda x: 1.0 if x > 0.04 else x * x)


@register("set_index_resample", "WITH b AS (SELECT date_trunc('day', ts)::timestamp AS ts, avg(value) AS value FROM events GROUP BY 1) SELECT s.ts, round(b.value, 6) AS value FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM b) s LEFT JOIN b USING (ts)")
def _(spark, d):
    return rounded(fr.set_index(T(spark, d, "events").select("ts", "value"), "ts").resample("D", "mean"))
