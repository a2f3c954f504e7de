"""Hand-computed cases of operators: missing values, empty inputs, ties, kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colframe.functions import special as sp
from colframe.operators import frames as fr
from colframe.operators import learning as L
from colframe.operators import matrices as M
from colframe.operators import neural as N
from colframe.operators import optimize as O
from colframe.operators import reshape as rs
from colframe.operators import signal as G
from colframe.operators import text as X
from colframe.operators import timeseries as ts
from colframe.sources import arrow_ipc, csvio

NAN = float("nan")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, NAN), (2, 3.0), (3, None)], "k long, v double")
    assert rows(fr.filter_gt(df, "v", 0.0)) == [(2, 3.0)] and fr.dropna(df).count() == 1
    assert rows(fr.fillna(df, 7.9)) == [(1, 7.9), (2, 3.0), (3, 7.9)]
    g = fr.group(df.withColumn("g", F.lit(1)), "g", [("v", "sum"), ("v", "count"), ("v", "mean")])
    assert rows(g) == [(1, 3.0, 1.0, 3.0)]
    none = fr.group(df.where("k <> 2").withColumn("g", F.lit(1)), "g", [("v", "sum"), ("v", "mean")])
    assert rows(none) == [(1, 0.0, None)]
    assert rows(fr.sort_values(df, "v", True, "k"))[0][0] == 2 and [r[0] for r in rows(fr.sort_values(df, "v", False, "k"))] == [1, 3, 2]


def test_saturating_sum(spark):
    df = spark.createDataFrame([(1, 2**62), (1, 2**62), (1, 2**62)], "g int, v long")
    assert rows(fr.group(df, "g", [("v", "sum")], "null")) == [(1, 2**63 - 1)]


def test_merge_names_and_keys(spark):
    a, b = spark.createDataFrame([(1, 2.0), (None, 3.0)], "k int, v double"), spark.createDataFrame([(None, 4.0), (5, 6.0)], "k int, v double")
    out = fr.merge(a, b, "k", "outer")
    assert out.columns == ["k", "v_x", "v_y"]
    assert sorted(rows(out), key=str) == sorted([(1, 2.0, None), (None, 3.0, 4.0), (5, None, 6.0)], key=str)
    assert fr.join(a, b, "k").columns == ["k", "v", "v_right"]
    for bad in (lambda: fr.merge(a, b, "k", "cross"), lambda: fr.join(a, b, "k", "outer")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        fr.select(a, ["nope"])


def test_pivot_empty_cells_and_codes(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "i int, c string, v double")
    assert sorted(rows(rs.pivot_table(df, "i", "c", "v", "sum"))) == [(1, 2.0, 0.0), (2, 0.0, 3.0)]
    assert sorted(rows(rs.pivot_table(df, "i", "c", "v", "mean"))) == [(1, 2.0, None), (2, None, 3.0)]
    c = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string")
    assert sorted(r.code for r in rs.categorical_codes(c, "c").collect()) == [-1, 0, 1, 1]
    assert sorted(rows(rs.melt(spark.createDataFrame([(1, True, "x")], "i int, b boolean, s string"), ["i"]))) == [(1, "b", "True"), (1, "s", "x")]


def test_blocks_agree_with_global_windows(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    got = {r.k: (r.s, r.n) for r in fr.running(df, "k", s="sum:v", n="count").collect()}
    assert all(got[k] == (sum(i % 7 for i in range(k + 1)), k + 1) for k in range(100))
    roll = {r.k: r.v_mean for r in ts.rolling_blocks(df, ["v"], 5, "mean", "k", 8).collect()}
    assert all((roll[k] is None) == (k < 4) for k in range(100)) and roll[50] == pytest.approx(np.mean([i % 7 for i in range(46, 51)]))
    assert {r.v: r["rank"] for r in fr.rankdata(spark.createDataFrame([(2.0,), (1.0,), (2.0,)], "v double"), "v").collect()} == {1.0: 1.0, 2.0: 2.5}


def test_kernels():
    assert sp.t_cdf_(np.array([2.0]), 5)[0] == pytest.approx(0.9490302605850709)
    assert sp.gammainc_(2.0, np.array([1.0, 9.0])) == pytest.approx([0.2642411176571153, 0.9987659019591332])
    assert sp.betainc_(2, 3, np.array([0.5]))[0] == pytest.approx(0.6875)
    assert sp.gamma_(np.array([5.0, 0.5, -0.5])) == pytest.approx([24, math.sqrt(math.pi), -2 * math.sqrt(math.pi)])
    assert sp.ndtri_(np.array([0.975]))[0] == pytest.approx(1.959963984540054) and sp.bessel_i0_(np.array([1.0]))[0] == pytest.approx(1.2660658777520084)
    assert sp.KERNELS["poisson_cdf"](np.array([2.0]), 3.0)[0] == pytest.approx(0.42319008112684353)
    assert sp.KERNELS["binom_cdf"](np.array([6.0]), 20.0, 0.3)[0] == pytest.approx(0.6080098122009244)
    assert sp.KERNELS["chi2_ppf"](np.array([0.95]), 4.0)[0] == pytest.approx(9.487729036781154)


def test_signal_kernels():
    b, a = G.butter(2, 0.5)
    assert b == pytest.approx([0.2928932188134524, 0.5857864376269049, 0.2928932188134524]) and a == pytest.approx([1, 0, 0.1715728752538099], abs=1e-12)
    y, _ = G.lfilter([1.0], [1.0, -0.5], np.array([1.0, 0, 0, 0]))
    assert y.tolist() == [1, 0.5, 0.25, 0.125]
    assert G.filtfilt(b, a, np.ones(40)) == pytest.approx(np.ones(40))
    assert G.fftconvolve(np.arange(5.0), np.array([1.0, 2, 3]), "same") == pytest.approx(np.convolve(np.arange(5.0), [1, 2, 3], "same"))
    w = G.welch(np.sin(np.arange(64) * np.pi / 4), 1.0, 16)
    assert w["f"][np.argmax(w["p"])] == 0.125


@pytest.mark.parametrize("kind", ["dense", "sparse", "missing", "infinite"])
def test_tiled_product_is_the_join(spark, monkeypatch, kind):
    """Tiles give the cells of the join: absent and null cells, doubles of a cell, infinite values, far and null indices."""
    r = np.random.default_rng(3)
    a = [(int(i) * 10**12 - 7, f"k{k}", float(r.normal())) for i in range(13) for k in range(11) if kind in ("dense", "missing") or r.random() < 0.2]
    b = [(f"k{k}", j, float(r.normal())) for k in range(2, 12) for j in range(9) if kind == "dense" or r.random() < 0.5]
    if kind == "missing":
        a = [(i, k, None if r.random() < 0.5 else v) for i, k, v in a] + [(None, "k3", 2.0), (1, None, 5.0), (1, "k4", 1.0), (1, "k4", 2.0), (3, "k5", None)]
    if kind == "infinite":
        a += [(5, "k3", float("inf")), (5, "k4", float("-inf")), (6, "k5", float("inf")), (6, "k6", NAN)]
    a, b = spark.createDataFrame(a, "i long, j string, v double"), spark.createDataFrame(b, "i string, j int, v double")
    want = {(x.i, x.j): x.v for x in M.matmul(a, b).collect()}
    monkeypatch.setattr(M, "PAIRS", 7)
    for side in (4, 1 << 10):
        monkeypatch.setattr(M, "SIDE", side)
        left, right = a.toDF("i", "k", "x").where("k IS NOT NULL"), b.toDF("k", "j", "y")
        parts = M._tiled(left, right, 13 // side + 1, 9 // side + 1, 12 // side + 1)
        got = {(x.i, x.j): x.v for x in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
        assert got.keys() == want.keys()
        assert all((got[c] is None) == (v is None) and (v is None or got[c] == pytest.approx(v, nan_ok=True)) for c, v in want.items())


def test_products_of_many_pairs_are_tiled(spark, monkeypatch):
    """No pair of cells becomes a row of a join, and a sparse product stays one."""
    monkeypatch.setattr(M, "FEW", 100)
    monkeypatch.setattr(M, "SIDE", 64)
    d = spark.range(3000).select((F.col("id") / 20).cast("long").alias("i"), (F.col("id") % 20).alias("j"), (F.col("id") % 7 + 0.5).alias("v"))
    m = np.array([r.v for r in d.orderBy("i", "j").collect()]).reshape(150, 20)
    for out, want in ((M.matmul(d, M.transpose(d)), m @ m.T), (M.gram(d), m.T @ m)):
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
        got = np.full(want.shape, NAN)
        for r in out.collect():
            got[r.i, r.j] = r.v
        assert got == pytest.approx(want)
    e = M.eye(spark, 500)
    out = M.matmul(e, e)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 500


def test_kmeans_sums_in_tasks(spark, monkeypatch):
    """Steps leave tasks as sums, not a row a component, and give Lloyd's centres; vectors with nulls take no part."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(300, 6)), r.normal(size=(200, 6)) + 2, np.repeat(r.normal(size=(1, 6)), 20, 0)])
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1002, [1.0])]
    want = x[:3].copy()
    for _ in range(4):
        own = ((x[:, None] - want) ** 2).sum(2).argmin(1)
        want = np.array([x[own == c].mean(0) for c in range(3)])
    seen, posexplode = [], F.posexplode
    monkeypatch.setattr(F, "posexplode", lambda c: seen.append(c) or posexplode(c))
    df = spark.createDataFrame(data, "id long, x array<double>")
    m = L.KMeans(3, 4).fit(df, "x", "id")
    assert np.array(m.centres) == pytest.approx(want) and seen and "x" not in seen
    own = ((x[:, None] - want) ** 2).sum(2).argmin(1)
    got = dict(rows(df.select("id", m.predict(F.col("x")))))
    assert [got[i] for i in range(len(x))] == own.tolist() and [got[i] for i in (1000, 1001, 1002)] == [None] * 3
    empty = L.KMeans(2, 1).fit(spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [4.0])], "id long, x array<double>"), "x", "id")
    assert empty.centres == [[4 / 3], [0.0]]  # ties to the lowest centre, an empty one stays
    far = L._nearest(np.array([[NAN, np.inf, 1.0]]), np.array([[NAN], [np.inf], [0.0]]))
    assert far.tolist() == [0, 2, 2]


def test_many_integrals_at_once(spark, monkeypatch):
    """The intervals of quad for each integral, in blocks of any size; parameters in one file are dealt over the cores."""
    c = np.array([0.3, 1.0, 7.0, 40.0, NAN])
    want = [O.quad(lambda x, k=k: k * math.exp(-k * x), 0.0, 2.0 + i) for i, k in enumerate(c)]
    for panels in (1, 3, 1 << 15):
        monkeypatch.setattr(O, "PANELS", panels)
        got = O.quad_many(lambda x, at: c[at] * np.exp(-c[at] * x), np.zeros(5), 2.0 + np.arange(5))
        assert got == pytest.approx(want, rel=1e-12, nan_ok=True)
    p = spark.range(0, 400, 1, 1)
    for out in (O.over_batches(p, lambda g: {"id": g.id, "y": g.id * 2.0}, "id long, y double"), O.over_parameters(p, lambda r: {"id": [r.id], "y": [r.id * 2.0]}, "id long, y double")):
        assert sorted(rows(out)) == [(i, 2.0 * i) for i in range(400)]
        assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_optimisers():
    assert O.quad(math.exp, 0, 1) == pytest.approx(math.e - 1) and O.dblquad(lambda y, x: x * y, 0, 1, lambda x: 0.0, lambda x: x) == pytest.approx(1 / 8)
    for method in ("rk45", "rk23"):
        assert O.solve_ivp(lambda t, y: np.array([y[1], -y[0]]), (0, 3), [0.0, 1.0], [1.0, 3.0], method=method)[:, 0] == pytest.approx([math.sin(1), math.sin(3)], abs=1e-4)
    rosen = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    assert O.nelder_mead(rosen, [-1.0, 1.0], 2000)[0] == pytest.approx([1, 1], abs=1e-4)
    grad = lambda x: np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])
    assert O.lbfgsb(rosen, grad, [-1.0, 1.0], [(-5, 0.5), (-5, 5)])[0] == pytest.approx([0.5, 0.25], abs=1e-4)
    t = np.arange(6.0)
    fit = O.least_squares(lambda p: p[0] * np.exp(p[1] * t) - 2 * np.exp(-0.5 * t), lambda p: np.stack([np.exp(p[1] * t), p[0] * t * np.exp(p[1] * t)], 1), [1.0, 0.0])
    assert fit == pytest.approx([2, -0.5], abs=1e-6)


@pytest.mark.parametrize(
    "layer,shape",
    [
        (N.Linear(N.lcg_uniform(12, 1).reshape(3, 4), np.zeros(3)), (2, 4)),
        *[(N.Activation(a), (2, 5)) for a in N.ACTIVATIONS],
        (N.LayerNorm(np.array([1.0, 2, 3]), np.zeros(3)), (4, 3)),
        (N.BatchNorm(np.array([1.0, 2, 3]), np.zeros(3)), (5, 3)),
        (N.Conv2d(N.lcg_uniform(18, 2).reshape(1, 2, 3, 3), np.zeros(1)), (1, 2, 5, 5)),
        (N.Pool2d("max", 2), (1, 1, 4, 4)),
        (N.Pool2d("avg", 2), (1, 1, 4, 4)),
        (N.Sequential(N.Linear(N.lcg_uniform(12, 1).reshape(3, 4)), N.Activation("tanh"), N.Linear(N.lcg_uniform(6, 7).reshape(2, 3))), (3, 4)),
    ],
)
def test_gradients(layer, shape):
    assert N.gradcheck(layer, N.lcg_uniform(int(np.prod(shape)), 9, -1, 1).reshape(shape)) < 1e-5


def test_network_parts():
    m = N.Sequential(N.Linear(np.eye(2)))
    saved = {k: v.copy() for k, v in N.state(m).items()}
    N.Adam(0.1).step(N.state(m), {"0.weight": np.ones((2, 2))})
    assert m.layers[0].params["weight"][0, 0] == pytest.approx(0.9)
    N.load_state(m, saved)
    assert (m.layers[0].params["weight"] == np.eye(2)).all()
    assert sorted(N.permutation(9, 4)) == list(range(9)) and N.adaptive_avg_pool2d(np.ones((1, 1, 5, 5)), 2, 2).shape == (1, 1, 2, 2)
    x = N.lcg_uniform(16, 3).reshape(1, 2, 8)
    p = {"in_w": np.eye(24, 8), "in_b": np.zeros(24), "out_w": np.eye(8), "out_b": np.zeros(8), "w1": np.eye(8), "b1": np.zeros(8), "w2": np.eye(8), "b2": np.zeros(8), "n1w": np.ones(8), "n1b": np.zeros(8), "n2w": np.ones(8), "n2b": np.zeros(8)}
    cross = {k: p[k] for k in ("in_w", "in_b", "out_w", "out_b")} | {"nw": np.ones(8), "nb": np.zeros(8)}
    assert N.encoder_layer(x, p, 2).shape == N.decoder_layer(x, x, p, cross, 2, mask=N.causal_mask(2)).shape == (1, 2, 8)
    assert N.gru(x, np.ones((9, 8)), np.ones((9, 3)), np.zeros(9), np.zeros(9))[1].shape == (1, 3)


def test_murmur_and_pieces():
    assert X.murmur3(["", "hello", "abc", "hello, world"]).tolist() == [0, 613153351, -1277324294, 345750399]
    t = X.MergeTokenizer([("a", "b"), ("ab", "c")])
    assert t.pieces("abcab") == ["abc", "ab"] and list(t.ids) == ["[UNK]", "a", "b", "ab", "c", "abc"]
    w = X.WordPieceTokenizer(["un", "##able", "##a"])
    assert w.pieces("unable") == ["un", "##able"] and w.pieces("xyz") == ["[UNK]"] and w.pieces("u" * 101) == ["[UNK]"]


def test_dense_factors():
    a = np.array([[4.0, 2, 1], [2, 5, 3], [1, 3, 6]])
    p, lower, u = M.factor(a, "lu")
    assert p @ lower @ u == pytest.approx(a) and M.factor(np.array([[0.0, 1], [-1, 0]]), "expm") == pytest.approx(np.array([[math.cos(1), math.sin(1)], [-math.sin(1), math.cos(1)]]))


def test_learning_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0], 1.0), (2, [1.0], 3.0), (3, [2.0], 5.0)], "k long, x array<double>, y double")
    m = L.LinearRegression().fit(df, "x", "y")
    assert (m.intercept, m.coef[0]) == pytest.approx((1, 2))
    a = L.Artifact.of(m)
    a.save(spark, str(tmp_path / "m"))
    assert L.Artifact.load(spark, str(tmp_path / "m")).values == a.values
    const = spark.createDataFrame([(5.0,), (5.0,)], "c double")
    assert rows(L.StandardScaler().fit(const, ["c"]).transform(const)) == [(0.0,), (0.0,)]
    train, test = L.split(df, "k", 0.01)
    assert (train.count(), test.count()) == (2, 1)


def test_csv_and_arrow(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', True, 1.5, None), (2, None, False, NAN, None)], "i long, s string, b boolean, f double, e double")
    csvio.write(df.coalesce(1), str(tmp_path / "c"))
    back = csvio.read(spark, str(tmp_path / "c"))
    assert back.dtypes == [("i", "bigint"), ("s", "string"), ("b", "boolean"), ("f", "double"), ("e", "boolean")]
    assert sorted(rows(back.select("i", "s", "b", "f"))) == [(1, 'a "b", c\nd', True, 1.5), (2, None, False, None)]
    (tmp_path / "n.csv").write_text("a,b,c\n123456789012345678,1.0,+5\n-3,2.,\n")
    for lines in (True, False):
        got = csvio.read(spark, str(tmp_path / "n.csv"), lines=lines)
        assert got.dtypes == [("a", "bigint"), ("b", "bigint"), ("c", "bigint")] and sorted(rows(got), key=str) == [(-3, 2, None), (123456789012345678, 1, 5)]
    import pyarrow as pa

    t = pa.table({"x": pa.array([1, 2, None]), "d": pa.array(["u", "v", "u"]).dictionary_encode(), "l": pa.array([[1.0], [], None], pa.list_(pa.float64()))})
    with pa.ipc.new_file(str(tmp_path / "t.arrow"), t.schema) as w:
        w.write_table(t)
    assert rows(arrow_ipc.read(spark, str(tmp_path / "t.arrow"))) == [(1, "u", [1.0]), (2, "v", []), (None, "u", None)]


def test_streaming_matches_batch(spark, tmp_path):
    from colframe.streaming import windows

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value")
    e.write.parquet(str(tmp_path / "in"))
    s = windows.resample(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "ts", "value", "h")
    q = s.writeStream.format("memory").queryName("resampled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.ts: round(r["sum"], 4) for r in spark.table("resampled").collect()}
    want = {r.ts: round(r.value, 4) for r in ts.resample(e, "ts", "h", "sum").collect() if r.value}
    assert got == want


def test_autograd_against_differences():
    from colframe.operators import autograd as A

    rng = np.random.default_rng(2)
    x, w, b = rng.normal(size=(3, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    assert A.gradcheck(lambda x, w, b: ((x @ w + b).tanh() * 2.0 + (x @ w).relu()).sum(), x, w, b) < 1e-6
    assert A.gradcheck(lambda x, w: ((x.exp() / (x.exp() + 1.0)).reshape(2, 6).transpose() @ (w.sigmoid().reshape(2, 4))).mean(), x, w) < 1e-6
    assert A.gradcheck(lambda x: (x[1] * x[0] - x[2]).sum() + (x * x + 1.0).log().sqrt().sum(), x) < 1e-6
    square = lambda t: A.apply_function(lambda saved, v: saved.append(v) or v * v, lambda saved, g: (2 * g * saved[0],), t)
    t = A.Tensor(x, True)
    square(t).sum().backward()
    (square(t) * 1.0).sum().backward()
    assert np.allclose(t.grad, 4 * x) and np.allclose(A.grad(square(t).sum(), [t])[0], 2 * x) and np.allclose(t.grad, 4 * x)
    with A.no_grad():
        assert not (t * 2.0).requires_grad and not A.is_grad_enabled()
    assert (t * 2.0).requires_grad


def test_shapes_against_numpy(spark):
    from colframe.functions import shapes as H

    x = np.arange(24.0)
    a, v = x.reshape(2, 3, 4), F.col("v")
    df = spark.createDataFrame([(x.tolist(), [2, 0, 1, 1, 0, 2, 1, 1])], "v array<double>, i array<int>")
    cases = [
        (H.moveaxis(v, (2, 3, 4), 2, 0), np.moveaxis(a, 2, 0)),
        (H.permute(v, (2, 3, 4), (1, 2, 0)), a.transpose(1, 2, 0)),
        (H.squeeze(*H.expand_dims(v, (2, 3, 4), 1), 1), a),
        (H.index_axis(v, (2, 3, 4), 2, 3), a[:, :, 3]),
        (H.slice_axes(v, (2, 3, 4), [slice(None, None, -1), slice(1, None)]), a[::-1, 1:]),
        (H.broadcast_to(v, (2, 1, 12), (2, 2, 12)), np.broadcast_to(x.reshape(2, 1, 12), (2, 2, 12))),
        (H.concatenate([v, v], [(2, 12), (2, 12)], 1), np.concatenate([x.reshape(2, 12)] * 2, 1)),
        (H.stack([v, v], (2, 3, 4), 3), np.stack([a, a], 3)),
        (H.take_along_axis(v, (2, 3, 4), F.col("i"), 1, 1), np.take_along_axis(a, np.array([2, 0, 1, 1, 0, 2, 1, 1]).reshape(2, 1, 4), 1)),
        (H.reshape(v, (2, 3, 4), (6, -1)), x.reshape(6, 4)),
    ]
    row = df.select(*[c.alias(f"c{i}") for i, ((c, _), _) in enumerate(cases)]).first()
    for got, ((_, shape), want) in zip(row, cases):
        assert shape == want.shape and got == want.ravel().tolist()
    with pytest.raises(ValueError):
        H.resolve(24, (5, -1))


def test_batched_algebra_against_numpy(spark):
    from colframe.operators import batched as B

    rng = np.random.default_rng(3)
    a = rng.normal(size=(20, 4, 4))
    p, l, u = B.lu(a)
    assert np.allclose(p @ l @ u, a) and np.allclose(np.triu(l, 1), 0) and np.allclose(np.tril(u, -1), 0) and (np.abs(l) <= 1 + 1e-12).all()
    for m, e in zip(a, B.expm(a)):
        w, x = np.linalg.eig(m)
        assert np.allclose(e, (x * np.exp(w) @ np.linalg.inv(x)).real)
    df = spark.createDataFrame([(a[0].ravel().tolist(),), (None,)], "m array<double>")
    got = [r[0] for r in df.select(B.apply("det", (4, 4), F.col("m"))).collect()]
    assert got[0] == pytest.approx([np.linalg.det(a[0])]) and got[1] is None
    w = np.array(df.select(B.apply("eigvals", (4, 4), F.col("m"))).first()[0]).reshape(-1, 2)
    assert np.allclose(w[:, 0] + 1j * w[:, 1], np.sort_complex(np.linalg.eigvals(a[0]).astype(complex)))


def test_order_statistics_with_odd_values(spark):
    v = [5.0, None, NAN, 1.0, 1.0, 1e12, -3.0, 5.0, 5.0]
    df = spark.createDataFrame(list(enumerate(v)), "i long, v double").repartition(7)
    ranks = {r.i: r["rank"] for r in fr.rankdata(df, "v").collect()}
    assert ranks == {0: 5.0, 1: None, 2: 8.0, 3: 2.5, 4: 2.5, 5: 7.0, 6: 1.0, 7: 5.0, 8: 5.0}
    x = [r for r in v if r is not None and not math.isnan(r)]
    d = {r.s: r.v for r in fr.describe(df, "s").collect()}
    assert [d["25%"], d["50%"], d["75%"]] == pytest.approx(np.percentile(x, [25, 50, 75]).tolist()) and d["count"] == 7
    run = {r.i: (r.t, r.n) for r in fr.running(df.where("v < 1e9"), "i", t="sum:v", n="count").collect()}
    assert run == {0: (5.0, 1), 3: (6.0, 2), 4: (7.0, 3), 6: (4.0, 4), 7: (9.0, 5), 8: (14.0, 6)}
    empty = df.where("false")
    assert fr.rankdata(empty, "v").count() == 0 and fr.describe(empty, "s").count() == 8 and fr.running(empty, "i", n="count").count() == 0
