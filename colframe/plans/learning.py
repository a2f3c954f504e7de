"""Queries over text, classical learning, signals, optimisation and networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from colframe.operators import learning as L
from colframe.operators import neural as N
from colframe.operators import optimize as O
from colframe.operators import signal as G
from colframe.operators import text as X
from colframe.plans.catalog import register
from colframe.plans.relational import T, rounded

SP = r"'\s+'"
WS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
MERGES = [("t", "h"), ("th", "e"), ("a", "n"), ("e", "r"), ("i", "n")]
CONV = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"


def conv(spark, d):
    return T(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


@register(
    "whitespace_encode",
    f"WITH t AS (SELECT id, unnest({WS}) AS w, generate_subscripts({WS}, 1) AS p FROM ({CONV})), v AS (SELECT w, row_number() OVER (ORDER BY encode(w)) AS i FROM (SELECT DISTINCT w FROM t)) SELECT id, list(i ORDER BY p) AS ids FROM t JOIN v USING (w) GROUP BY 1",
)
def _(spark, d):
    c = conv(spark, d)
    return X.WhitespaceTokenizer().fit(c, "text").encode(c, "id", "text").select("id", "ids")


@register("whitespace_decode", f"SELECT id, array_to_string({WS}, ' ') AS text FROM ({CONV}) WHERE len({WS}) > 0")
def _(spark, d):
    c = conv(spark, d)
    t = X.WhitespaceTokenizer().fit(c, "text")
    return t.decode(t.encode(c, "id", "text"), "id", "ids")


@register("word_tokenize", r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS tokens FROM documents")
def _(spark, d):
    return T(spark, d, "documents").select("doc_id", X.word_tokens(F.col("text")).alias("tokens"))


TOK = r"SELECT conv_id * 1000 + turn AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM conversations"


@register("count_vectorizer", f"WITH t AS ({TOK}), v AS (SELECT w, row_number() OVER (ORDER BY encode(w)) - 1 AS id2 FROM (SELECT DISTINCT w FROM t)) SELECT t.id AS doc, v.id2 AS id, count(*) AS n FROM t JOIN v USING (w) GROUP BY 1, 2")
def _(spark, d):
    return X.count_vectors(conv(spark, d).withColumnRenamed("id", "doc"), "doc", "text")[0]


# MurmurHash3 of each distinct word: blocks of four bytes (little-endian, from hexadecimal text) folded in HUGEINT
M32 = "4294967296::hugeint"
MIX = f"((({{k}} * 3432918353) % {M32} * 32768 + (({{k}} * 3432918353) % {M32}) // 131072) % {M32} * 461845907) % {M32}"
HASHED = f"""
SELECT w, xor(xor(h4, h4 // 8192) * 3266489909::hugeint % {M32}, 0::hugeint) AS h5 FROM (
SELECT w, xor(h3, h3 // 65536) * 2246822507::hugeint % {M32} AS h4 FROM (
SELECT w, xor(CASE WHEN n % 4 = 0 THEN h ELSE xor(h, {MIX.format(k="tail")}) END, n::hugeint) AS h3 FROM (
SELECT w, n, CASE WHEN n % 4 = 0 THEN 0 ELSE list_sum(list_transform(range(0, n % 4), lambda i: ('0x' || x[2 * (n // 4 * 4 + i) + 1:2 * (n // 4 * 4 + i) + 2])::hugeint * (1 << (8 * i)))) END::hugeint AS tail,
list_reduce(list_prepend(0::hugeint, list_transform(range(0, n // 4), lambda b: list_sum(list_transform(range(0, 4), lambda i: ('0x' || x[2 * (4 * b + i) + 1:2 * (4 * b + i) + 2])::hugeint * (1 << (8 * i))))::hugeint)),
  lambda h, k: ((xor(h, {MIX.format(k="k")}) * 8192 + xor(h, {MIX.format(k="k")}) // 524288) % {M32} * 5 + 3864292196) % {M32}) AS h
FROM (SELECT w, hex(encode(w)) AS x, octet_length(encode(w)) AS n FROM (SELECT DISTINCT w FROM t)))))"""
SIGNED = f"SELECT w, CASE WHEN h6 >= 2147483648 THEN h6 - {M32} ELSE h6 END AS s FROM (SELECT w, xor(h5, h5 // 65536) AS h6 FROM ({HASHED}))"


@register("hashing_vectorizer", f"WITH t AS ({TOK}), m AS ({SIGNED}) SELECT id, (abs(s) % 4096)::bigint AS feature, sum(CASE WHEN s >= 0 THEN 1.0 ELSE -1.0 END)::double AS value FROM t JOIN m USING (w) GROUP BY 1, 2")
def _(spark, d):
    return X.hash_vectors(conv(spark, d), "id", "text", 4096)


MERGED = "' ' || array_to_string(string_split(w, ''), '  ') || ' '"
for _a, _b in MERGES:
    MERGED = f"replace({MERGED}, ' {_a}  {_b} ', ' {_a}{_b} ')"
PIECES = "SELECT id, [CASE WHEN i > 0 THEN i - 1 ELSE 0 END FOR i IN list_transform(p, lambda x: coalesce(list_position(v, x), 0))] AS ids, list_transform(p, lambda x: CASE WHEN list_contains(v, x) THEN x ELSE '[UNK]' END) AS tokens FROM (SELECT id, {p} AS p, {v}::varchar[] AS v FROM (SELECT id, flatten(list_transform(" + WS + ", lambda w: {split})) AS p FROM (" + CONV + ")) WHERE len(p) > 0)"


@register("bpe_merges", PIECES.format(p="p", v=["[UNK]", *dict.fromkeys(t for a, b in MERGES for t in (a, b, a + b))], split=f"string_split(trim({MERGED}), '  ')"))
def _(spark, d):
    return X.encode_words(conv(spark, d), "id", "text", X.MergeTokenizer(MERGES))


ALPHABET = [chr(c) for c in range(97, 123)]
WORDPIECES = [*ALPHABET, *["##" + c for c in ALPHABET], "the", "##the", "##tion", "and", "##er"]
GREEDY = "CASE WHEN regexp_full_match(w, '[a-z]{1,100}') THEN list_prepend(regexp_extract(w, '^(the|and|[a-z])'), list_transform(regexp_extract_all(w[len(regexp_extract(w, '^(the|and|[a-z])')) + 1:], 'tion|the|er|[a-z]'), lambda x: '##' || x)) ELSE ['[UNK]'] END"


@register("wordpiece", PIECES.format(p="p", v=["[UNK]", *WORDPIECES], split=GREEDY.replace("{1,100}", "{{1,100}}").replace("{{", "{").replace("}}", "}")))
def _(spark, d):
    return X.encode_words(conv(spark, d), "id", "text", X.WordPieceTokenizer(WORDPIECES))


# --- classical learning

@register("train_test_split", "SELECT p_partkey, p_partkey >= (SELECT min(k) FROM (SELECT p_partkey AS k FROM part ORDER BY 1 DESC LIMIT (SELECT ceil(count(*) * 0.25)::bigint FROM part))) AS test FROM part")
def _(spark, d):
    train, test = L.split(T(spark, d, "part").select("p_partkey"), "p_partkey", 0.25)
    return train.withColumn("test", F.lit(False)).union(test.withColumn("test", F.lit(True)))


@register("train_test_split_shuffled", "SELECT p_partkey, row_number() OVER (ORDER BY md5('7:' || p_partkey)) > (SELECT count(*) - ceil(count(*) * 0.25) FROM part) AS test FROM part")
def _(spark, d):
    train, test = L.split(T(spark, d, "part").select("p_partkey"), "p_partkey", 0.25, seed=7)
    return train.withColumn("test", F.lit(False)).union(test.withColumn("test", F.lit(True)))


@register("shuffle_rows", "SELECT event_id, row_number() OVER (ORDER BY md5('3:' || event_id)) - 1 AS at FROM events")
def _(spark, d):
    return L.shuffle_rows(T(spark, d, "events").select("event_id"), "event_id", 3)


@register("standard_scaler", "SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) + 0.0 AS p_size, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) + 0.0 AS p_retailprice FROM part")
def _(spark, d):
    p = T(spark, d, "part")
    out = L.StandardScaler().fit(p, ["p_size", "p_retailprice"]).transform(p)
    return out.select("p_partkey", *[(F.round(c, 6) + 0.0).alias(c) for c in ("p_size", "p_retailprice")])


@register("label_encoder", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::bigint AS code FROM customer")
def _(spark, d):
    c = T(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return L.LabelEncoder().fit(c, "c_mktsegment").transform(c, "c_mktsegment", "code").select("c_custkey", "code")


def features(spark, d):
    x = T(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("c"))


@register(
    "linear_regression",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem",
)
def _(spark, d):
    x = T(spark, d, "lineitem").select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    m = L.LinearRegression().fit(x, "x", "y")
    return spark.createDataFrame([(round(m.coef[0], 3), round(m.intercept, 2))], "slope double, intercept double")


FEATURES = "SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3, l_extendedprice AS y, (l_quantity > 25)::int AS c FROM lineitem"
MOMENTS = "SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, var_pop(x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x1, x3) AS c, var_pop(x2) AS e, covar_pop(x2, x3) AS f, var_pop(x3) AS i, covar_pop(x1, y) AS g, covar_pop(x2, y) AS h, covar_pop(x3, y) AS k FROM x"
CRAMER = "SELECT *, a * (e * i - f * f) - b * (b * i - c * f) + c * (b * f - c * e) AS det FROM m"
SOLVED = "SELECT m1, m2, m3, my, (g * (e * i - f * f) - b * (h * i - f * k) + c * (h * f - e * k)) / det AS w1, (a * (h * i - f * k) - g * (b * i - f * c) + c * (b * k - h * c)) / det AS w2, (a * (e * k - h * f) - b * (b * k - h * c) + g * (b * f - e * c)) / det AS w3 FROM d"


@register("linear_predict", f"WITH x AS ({FEATURES}), m AS ({MOMENTS}), d AS ({CRAMER}), s AS ({SOLVED}) SELECT l_orderkey, l_linenumber, round(my + w1 * (x1 - m1) + w2 * (x2 - m2) + w3 * (x3 - m3), 2) AS p FROM x, s")
def _(spark, d):
    x = features(spark, d)
    m = L.LinearRegression().fit(x, "x", "y")
    return x.select("l_orderkey", "l_linenumber", F.round(m.predict(F.col("x")), 2).alias("p"))


STEPS = 20
GRADIENT = "SELECT i, b, w1, w2, w3, avg(e) AS g, avg(e * x1) AS g1, avg(e * x2) AS g2, avg(e * x3) AS g3 FROM (SELECT *, 1 / (1 + exp(-(b + w1 * x1 + w2 * x2 + w3 * x3))) - c AS e FROM w, x WHERE i < {n}) GROUP BY i, b, w1, w2, w3"


@register(
    "logistic_regression",
    f"WITH RECURSIVE x AS MATERIALIZED ({FEATURES}), w(i, b, w1, w2, w3) AS (SELECT 0, 0.0::double, 0.0::double, 0.0::double, 0.0::double UNION ALL SELECT i + 1, b - g, w1 - g1, w2 - g2, w3 - g3 FROM ({GRADIENT.format(n=STEPS)})) SELECT c, (b + w1 * x1 + w2 * x2 + w3 * x3 >= 0)::bigint AS p, count(*) AS n FROM x, w WHERE i = {STEPS} GROUP BY 1, 2",
)
def _(spark, d):
    x = features(spark, d)
    m = L.LogisticRegression(rate=1.0, iterations=STEPS).fit(x, "x", "c")
    return x.groupBy("c", m.predict(F.col("x")).alias("p")).agg(F.count("*").alias("n"))


KNN = "SELECT q.vec_id AS query, t.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda p: (p[1]::double - p[2]) * (p[1]::double - p[2]))), t.vec_id) AS r FROM embeddings q, embeddings t WHERE q.vec_id % 10 = 0 AND t.vec_id % 10 <> 0"


@register("knn_classifier", f"SELECT query, label::bigint AS label FROM (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, label) AS k FROM ({KNN}) WHERE r <= 5 GROUP BY query, label) WHERE k = 1")
def _(spark, d):
    e = T(spark, d, "embeddings")
    return L.knn_classify(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "vec_id", "embedding", "vec_id", "label", 5)


@register("knn_regressor", f"SELECT query, round(avg(label), 6) AS prediction FROM ({KNN}) WHERE r <= 4 GROUP BY 1")
def _(spark, d):
    e = T(spark, d, "embeddings")
    return rounded(L.knn_regress(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "vec_id", "embedding", "vec_id", "label", 4))


LLOYD = 10
NEAR = "list_position([list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) FOR c IN cs], list_min([list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) FOR c IN cs]))"
MOVED = f"SELECT i, k, j, avg(v) AS m FROM (SELECT i, k, generate_subscripts(x, 1) AS j, unnest(x) AS v FROM (SELECT i, x, {NEAR} AS k FROM e, c WHERE i < {LLOYD})) GROUP BY 1, 2, 3"


@register(
    "kmeans",
    f"WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding::double[] AS x FROM embeddings), c(i, cs) AS (SELECT 0, list(x ORDER BY vec_id) FROM e WHERE vec_id IN (SELECT vec_id FROM e ORDER BY 1 LIMIT 3) UNION ALL SELECT any_value(i) + 1, list(x ORDER BY k) FROM (SELECT i, k, list(m ORDER BY j) AS x FROM ({MOVED}) GROUP BY 1, 2) GROUP BY i) SELECT vec_id, ({NEAR} - 1)::int AS cluster FROM e, c WHERE i = {LLOYD}",
)
def _(spark, d):
    e = T(spark, d, "embeddings")
    m = L.KMeans(3, LLOYD).fit(e, "embedding", "vec_id")
    return e.select("vec_id", m.predict(F.col("embedding").cast("array<double>")).alias("cluster"))


@register("model_artifact", "SELECT vec_id, round(embedding[1]::double * 2 - embedding[2]::double + 0.25, 6) + 0.0 AS p FROM embeddings")
def _(spark, d):
    m = L.LinearRegression()
    m.intercept, m.coef = 0.25, [2.0, -1.0]
    a = L.Artifact.from_json(L.Artifact.of(m).to_json())
    return T(spark, d, "embeddings").select("vec_id", (F.round(a.apply(F.slice("embedding", 1, 2).cast("array<double>")), 6) + 0.0).alias("p"))


# --- signals

def series(spark, d):
    return T(spark, d, "events").select("user_id", "event_id", "value")


def _series(name, f, schema, sql=None):
    @register(name, sql)
    def _(spark, d):
        out = G.per_series(series(spark, d), "user_id", "event_id", "value", f, schema)
        return out.select(*[(F.round(c, 4) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


SERIES = "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events"
DFT = "SELECT user_id, k.k::int AS k, round(sum(value * cos(-2 * pi() * (t * k.k % n) / n)), 4) + 0.0 AS re, round(sum(value * sin(-2 * pi() * (t * k.k % n) / n)), 4) + 0.0 AS im FROM x JOIN range((SELECT max(n) FROM x)) k(k) ON k.k {bound} GROUP BY 1, 2"
CUT = "SELECT user_id, (s // step)::int AS segment, t - s AS t, size, value * (0.5 - 0.5 * cos(2 * pi() * (t - s) / size)) AS v FROM (SELECT *, least(n, 16) AS size, least(n, 16) - least(n, 16) // 2 AS step FROM x) JOIN range((SELECT max(n) FROM x)) r(s) ON s % step = 0 AND t >= s AND t < s + size AND s + size <= n"
BINS = "SELECT user_id, segment, size, k, sqrt(pow(sum(v * cos(2 * pi() * (t * k % size) / size)), 2) + pow(sum(v * sin(2 * pi() * (t * k % size) / size)), 2)) AS m FROM c JOIN range(9) r(k) ON k <= size // 2 GROUP BY 1, 2, 3, 4"
HANN = "(SELECT sum({w}) FROM (SELECT 0.5 - 0.5 * cos(2 * pi() * j / size) AS h FROM range(size) r(j)))"
_LONGEST = "(SELECT max(n) FROM x)"


def _response(b, a):
    """The impulse response of a recursive filter as SQL: h[i] = b[i] - a[1] h[i-1] - ..., as long as the longest series."""
    back = " - ".join(f"({float(v)!r}) * CASE WHEN len(h) > {i} THEN h[len(h) - {i}] ELSE 0 END" for i, v in enumerate(a[1:]))
    front = f"coalesce({[float(v) for v in b]}[i + 1], 0)"
    return f"r(i, h) AS (SELECT 1, [{float(b[0])!r}::double] UNION ALL SELECT i + 1, list_append(h, {front} - {back}) FROM r WHERE i < {_LONGEST})"


_series("fft", G.fft, "k int, re double, im double", f"WITH x AS ({SERIES}) {DFT.format(bound='< n')}")
_series("rfft", G.rfft, "k int, re double, im double", f"WITH x AS ({SERIES}) {DFT.format(bound='<= n // 2')}")
_series(
    "lfilter",
    lambda x: (lambda y: {"k": np.arange(len(y)), "y": y})(G.lfilter(*G.butter(3, 0.3), x)[0]),
    "k int, y double",
    f"WITH RECURSIVE x AS ({SERIES}), {_response(*G.butter(3, 0.3))}, h AS (SELECT h FROM r ORDER BY i DESC LIMIT 1) SELECT a.user_id, a.t::int AS k, round(sum(b.value * h[a.t - b.t + 1]), 4) + 0.0 AS y FROM x a JOIN x b ON a.user_id = b.user_id AND b.t <= a.t, h GROUP BY 1, 2",
)
_series("filtfilt", lambda x: (lambda y: {"k": np.arange(len(y)), "y": y})(G.filtfilt(*G.butter(2, 0.4), x)), "k int, y double")
_series(
    "welch",
    lambda x: G.welch(x, 1.0, min(16, len(x))),
    "f double, p double",
    f"WITH x AS ({SERIES}), c AS ({CUT}), b AS ({BINS}) SELECT user_id, round(k / size, 4) + 0.0 AS f, round(avg(m * m) / {HANN.format(w='h * h')} * CASE WHEN k = 0 OR 2 * k = size THEN 1 ELSE 2 END, 4) + 0.0 AS p FROM b GROUP BY user_id, size, k",
)
_series(
    "stft",
    lambda x: G.stft(x, 1.0, min(16, len(x))),
    "f double, segment int, m double",
    f"WITH x AS ({SERIES}), c AS ({CUT}), b AS ({BINS}) SELECT user_id, round(k / size, 4) + 0.0 AS f, segment, round(m / {HANN.format(w='h')}, 4) + 0.0 AS m FROM b",
)


@register("irfft_roundtrip", "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::int AS k, round(value, 6) AS x FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1)")
def _(spark, d):
    out = G.per_series(series(spark, d), "user_id", "event_id", "value", G.irfft_of_rfft, "k int, x double")
    return rounded(out.join(series(spark, d).groupBy("user_id").count().where("count > 1").select("user_id"), "user_id", "left_semi"))


@register("fftfreq", "SELECT i AS k, (CASE WHEN i < 5 THEN i ELSE i - 9 END) / (9 * 0.5) AS f FROM range(9) t(i)")
def _(spark, d):
    return G.frequencies(spark, 9, 0.5)


@register("window_functions", "SELECT i AS k, round(0.5 - 0.5 * cos(2 * pi() * i / 15), 9) AS hann, round(0.54 - 0.46 * cos(2 * pi() * i / 15), 9) AS hamming, round(0.42 - 0.5 * cos(2 * pi() * i / 16) + 0.08 * cos(4 * pi() * i / 16), 9) + 0.0 AS blackman FROM range(16) t(i)")
def _(spark, d):
    a, b, c = G.window(spark, "hann", 16), G.window(spark, "hamming", 16), G.window(spark, "blackman", 16, False)
    out = a.withColumnRenamed("w", "hann").join(b.withColumnRenamed("w", "hamming"), "k").join(c.withColumnRenamed("w", "blackman"), "k")
    return out.select("k", *[(F.round(x, 9) + 0.0).alias(x) for x in ("hann", "hamming", "blackman")])


@register("convolve", "WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT user_id, i + j AS k, round(sum(value * w), 4) AS y FROM x, (VALUES (0, 0.25), (1, 0.5), (2, 0.25)) AS t(j, w) GROUP BY 1, 2")
def _(spark, d):
    from pyspark.sql import Window

    x = series(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    out = G.convolve(x, "user_id", "i", "value", [0.25, 0.5, 0.25])
    return rounded(out.withColumn("k", F.col("k").cast("bigint")), 4)


@register("detrend", "SELECT user_id, event_id, round(value - (regr_intercept(value, event_id) OVER w + regr_slope(value, event_id) OVER w * event_id), 4) + 0.0 AS detrended FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 2) WINDOW w AS (PARTITION BY user_id)")
def _(spark, d):
    x = series(spark, d)
    x = x.join(x.groupBy("user_id").count().where("count > 2").select("user_id"), "user_id", "left_semi")
    return G.detrend(x, "user_id", "event_id", "value").select("user_id", "event_id", (F.round("detrended", 4) + 0.0).alias("detrended"))


# --- quadrature, equations, minimisers over a table of parameters

@register("quadrature", "SELECT p_partkey, round((p_size % 5 + 1) * (1 - cos(2.0)), 6) AS area FROM part")
def _(spark, d):
    def area(g):
        height = (g.p_size % 5 + 1).to_numpy(float)
        return {"p_partkey": g.p_partkey, "area": O.quad_many(lambda x, at: height[at] * np.sin(x), np.zeros(len(g)), np.full(len(g), 2.0))}

    return rounded(O.over_batches(T(spark, d, "part").select("p_partkey", "p_size"), area, "p_partkey long, area double"))


@register("decay_equation", "SELECT s_suppkey, t::double AS t, round(exp(-(s_nationkey % 4 + 1) * t / 10.0), 4) AS y FROM supplier, range(1, 4) r(t)")
def _(spark, d):
    def run(r):
        rate = (r.s_nationkey % 4 + 1) / 10
        y = O.solve_ivp(lambda t, y: -rate * y, (0, 3), [1.0], [1, 2, 3])[:, 0]
        return {"s_suppkey": [r.s_suppkey] * 3, "t": [1.0, 2.0, 3.0], "y": y.round(4)}

    return O.over_parameters(T(spark, d, "supplier").select("s_suppkey", "s_nationkey"), run, "s_suppkey long, t double, y double")


@register("minimisers", "SELECT n_nationkey, round(n_nationkey / 7.0, 3) + 0.0 AS nm, round(least(n_nationkey / 7.0, 2.0), 3) + 0.0 AS bounded FROM nation")
def _(spark, d):
    def run(r):
        c = r.n_nationkey / 7
        nm = O.nelder_mead(lambda x: (x[0] - c) ** 2 + (x[1] + 1) ** 2, [0.5, 0.5])[0][0]
        b = O.lbfgsb(lambda x: float((x[0] - c) ** 2), lambda x: 2 * (x - c), [0.0], [(-1, 2)])[0][0]
        return {"n_nationkey": [r.n_nationkey], "nm": [round(nm, 3) + 0.0], "bounded": [round(b, 3) + 0.0]}

    return O.over_parameters(T(spark, d, "nation").select("n_nationkey"), run, "n_nationkey int, nm double, bounded double")


# --- networks

def _literal(a):
    """An array as a DuckDB list."""
    return str(np.asarray(a, float).tolist())


def _net(seed=1, width=64, hidden=8, out=4):
    w = N.lcg_uniform(hidden * width + out * hidden, seed, -0.5, 0.5)
    return N.Sequential(N.Linear(w[: hidden * width].reshape(hidden, width), np.zeros(hidden)), N.Activation("relu"), N.Linear(w[hidden * width :].reshape(out, hidden), np.zeros(out)))


_W = N.state(_net())
HIDDEN = f"list_transform({_literal(_W['0.weight'])}, lambda w: greatest(list_inner_product(w, embedding::double[]), 0.0))"


@register("mlp_inference", f"SELECT vec_id, list_transform({_literal(_W['2.weight'])}, lambda w: round(list_inner_product(w, h), 6) + 0.0) AS y FROM (SELECT vec_id, {HIDDEN} AS h FROM embeddings)")
def _(spark, d):
    return T(spark, d, "embeddings").select("vec_id", F.transform(N.predict(_net(), F.col("embedding")), lambda x: F.round(x, 6) + 0.0).alias("y"))


@register("mlp_training")
def _(spark, d):
    e = T(spark, d, "embeddings").select("embedding", (F.col("label") % 4).alias("y"))
    losses = N.train(e, "embedding", "y", _net(), N.Adam(0.05), epochs=12)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


@register("cross_entropy_loss", "SELECT round(avg(ln(list_sum(list_transform(z, lambda x: exp(x::double)))) - z[label % 4 + 1]), 6) AS loss FROM (SELECT embedding[1:4] AS z, label FROM embeddings)")
def _(spark, d):
    from colframe.functions import vectors as V

    e = T(spark, d, "embeddings").select(F.slice("embedding", 1, 4).cast("array<double>").alias("z"), "label")
    return e.agg(F.round(F.avg(-F.get(V.log_softmax(F.col("z")), F.col("label") % 4)), 6).alias("loss"))


class _Attend:
    def forward(self, x):
        return N.attention(x, x, x, N.causal_mask(x.shape[1]))


WEIGHT = "exp(list_inner_product(r[8 * i + 1:8 * i + 8], r[8 * j + 1:8 * j + 8]) / sqrt(8))"


@register(
    "attention",
    f"SELECT vec_id, flatten(list_transform(range(0, 8), lambda i: list_transform(range(1, 9), lambda c: round(list_sum(list_transform(range(0, i + 1), lambda j: {WEIGHT} * r[8 * j + c])) / list_sum(list_transform(range(0, i + 1), lambda j: {WEIGHT})), 6) + 0.0))) AS y FROM (SELECT vec_id, embedding::double[] AS r FROM embeddings)",
)
def _(spark, d):
    return T(spark, d, "embeddings").select("vec_id", F.transform(N.predict(_Attend(), F.col("embedding"), (8, 8)), lambda x: F.round(x, 6) + 0.0).alias("y"))


_KERNELS = N.lcg_uniform(18, 3, -1, 1)
CONVOLVED = "list_sum(list_transform(range(0, 9), lambda m: w[9 * (q // 9) + m + 1] * r[(2 * (q % 9 // 3) + z // 2 + m // 3) * 8 + 2 * (q % 3) + z % 2 + m % 3 + 1]))"


@register("conv_pool", f"SELECT vec_id, list_transform(range(0, 18), lambda q: round(list_max(list_transform(range(0, 4), lambda z: {CONVOLVED})), 6) + 0.0) AS y FROM (SELECT vec_id, embedding::double[] AS r, {_literal(_KERNELS)} AS w FROM embeddings)")
def _(spark, d):
    net = N.Sequential(N.Conv2d(N.lcg_uniform(18, 3, -1, 1).reshape(2, 1, 3, 3)), N.Pool2d("max", 2), N.Flatten())
    return T(spark, d, "embeddings").select("vec_id", F.transform(N.predict(net, F.col("embedding"), (1, 8, 8)), lambda x: F.round(x, 6) + 0.0).alias("y"))


class _Lstm:
    def forward(self, x):
        w = N.lcg_uniform(4 * 5 * (8 + 5), 5, -0.5, 0.5)
        return N.lstm(x, w[:160].reshape(20, 8), w[160:].reshape(20, 5), np.zeros(20), np.zeros(20))[1][0]


_GATES = N.lcg_uniform(4 * 5 * (8 + 5), 5, -0.5, 0.5)
LSTM = "SELECT vec_id, embedding::double[] AS r, [0, 0, 0, 0, 0]::double[] AS h, [0, 0, 0, 0, 0]::double[] AS c FROM embeddings"
for _t in range(8):
    LSTM = f"SELECT vec_id, r, list_transform(list_zip(g[16:20], c), lambda p: 1 / (1 + exp(-p[1])) * tanh(p[2])) AS h, c FROM (SELECT vec_id, r, g, list_transform(range(1, 6), lambda i: c[i] / (1 + exp(-g[5 + i])) + tanh(g[10 + i]) / (1 + exp(-g[i]))) AS c FROM (SELECT vec_id, r, c, list_transform(list_zip({_literal(_GATES[:160].reshape(20, 8))}, {_literal(_GATES[160:].reshape(20, 5))}), lambda w: list_inner_product(w[1], r[{8 * _t + 1}:{8 * _t + 8}]) + list_inner_product(w[2], h)) AS g FROM ({LSTM})))"


@register("lstm", f"SELECT vec_id, list_transform(h, lambda x: round(x, 6) + 0.0) AS y FROM ({LSTM})")
def _(spark, d):
    return T(spark, d, "embeddings").select("vec_id", F.transform(N.predict(_Lstm(), F.col("embedding"), (8, 8)), lambda x: F.round(x, 6) + 0.0).alias("y"))


def _layer(seed, width=8, hidden=16):
    """Parameters of an attention layer with its feed-forward part."""
    lcg = iter(N.lcg_uniform(4 * width * width + 4 * width + 2 * width * hidden + hidden + 5 * width, seed, -0.5, 0.5))
    cut = lambda *shape: np.array([next(lcg) for _ in range(int(np.prod(shape)))]).reshape(shape)
    p = {"in_w": cut(3 * width, width), "in_b": cut(3 * width), "out_w": cut(width, width), "out_b": cut(width), "w1": cut(hidden, width), "b1": cut(hidden), "w2": cut(width, hidden), "b2": cut(width)}
    return p | {"n1w": 1 + cut(width), "n1b": cut(width), "n2w": 1 + cut(width), "n2b": cut(width)}


class _Transformer:
    """An encoder layer over all rows of the image, and a decoder layer with a causal mask that attends to it."""

    def forward(self, x):
        memory = N.encoder_layer(x, _layer(11), 2, "gelu")
        p = _layer(12)
        cross = {k: p[k] for k in ("in_w", "in_b", "out_w", "out_b")} | {"nw": p["n2w"], "nb": p["n2b"]}
        return N.decoder_layer(x, memory, _layer(13), cross, 2, "relu", N.causal_mask(x.shape[1]))


@register("transformer")
def _(spark, d):
    return T(spark, d, "embeddings").select("vec_id", F.transform(N.predict(_Transformer(), F.col("embedding"), (8, 8)), lambda x: F.round(x, 6) + 0.0).alias("y"))


class _Gru:
    def forward(self, x):
        w = N.lcg_uniform(3 * 4 * (8 + 4), 6, -0.5, 0.5)
        return N.gru(x, w[:96].reshape(12, 8), w[96:].reshape(12, 4), np.zeros(12), np.zeros(12))[1]


_RESET = N.lcg_uniform(3 * 4 * (8 + 4), 6, -0.5, 0.5)
GRU = "SELECT vec_id, embedding::double[] AS r, [0, 0, 0, 0]::double[] AS h FROM embeddings"
for _t in range(8):
    GRU = f"SELECT vec_id, r, list_transform(range(1, 5), lambda i: (1 - 1 / (1 + exp(-(x[4 + i] + u[4 + i])))) * tanh(x[8 + i] + u[8 + i] / (1 + exp(-(x[i] + u[i])))) + h[i] / (1 + exp(-(x[4 + i] + u[4 + i])))) AS h FROM (SELECT vec_id, r, h, list_transform({_literal(_RESET[:96].reshape(12, 8))}, lambda w: list_inner_product(w, r[{8 * _t + 1}:{8 * _t + 8}])) AS x, list_transform({_literal(_RESET[96:].reshape(12, 4))}, lambda w: list_inner_product(w, h)) AS u FROM ({GRU}))"


@register("gru", f"SELECT vec_id, list_transform(h, lambda x: round(x, 6) + 0.0) AS y FROM ({GRU})")
def _(spark, d):
    return T(spark, d, "embeddings").select("vec_id", F.transform(N.predict(_Gru(), F.col("embedding"), (8, 8)), lambda x: F.round(x, 6) + 0.0).alias("y"))


@register("batch_norm", "WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) AS j, unnest(embedding)::double AS v FROM embeddings) SELECT vec_id, (j - 1)::int AS j, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 5) + 0.0 AS z FROM c WINDOW w AS (PARTITION BY j)")
def _(spark, d):
    c = T(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v")).withColumn("v", F.col("v").cast("double"))
    s = c.groupBy("j").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    return c.join(F.broadcast(s), "j").select("vec_id", "j", (F.round((F.col("v") - F.col("m")) / F.sqrt(F.col("s") + 1e-5), 5) + 0.0).alias("z"))  # a row per column


@register("embedding_lookup", "SELECT o_orderkey, e.embedding AS v FROM orders JOIN embeddings e ON o_custkey % 100 = vec_id")
def _(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("vec_id"))
    return o.join(T(spark, d, "embeddings"), "vec_id").select("o_orderkey", F.col("embedding").alias("v"))


@register("rate_schedules", "SELECT i AS epoch, round(0.1 * pow(0.5, i // 3), 9) AS step, round(0.1 * pow(0.1, (i >= 2)::int + (i >= 6)::int), 9) AS multi, round(0.05 * (1 + cos(i * pi() / 10)), 9) AS cosine FROM range(10) t(i)")
def _(spark, d):
    e = F.col("epoch")
    return spark.range(10).toDF("epoch").select("epoch", F.round(N.step_rate(0.1, e, 3, 0.5), 9).alias("step"), F.round(N.multi_step_rate(0.1, e, [2, 6]), 9).alias("multi"), F.round(N.cosine_rate(0.1, e, 10), 9).alias("cosine"))


@register("mini_batches", "SELECT event_id // 64 AS batch, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark, d):
    b = N.batches(T(spark, d, "events").select("event_id", "value"), "event_id", 64)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
