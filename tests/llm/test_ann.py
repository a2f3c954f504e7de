import numpy as np
import pytest

from colframe.llm import ann


def brute(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    asked = {i for i, v in queries}
    out = []
    for q in sorted({i for i, _ in ok if i in asked}):
        best = {}
        for x in (v for i, v in ok if i == q):
            for i, y in ok:
                if i != q and len(x) == len(y):
                    d = float(ann.distances(x[None], y[None])[0])
                    best[i] = min(d, best.get(i, d))
        out += [(q, r, i, d) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k], 1)]
    return out


@pytest.mark.parametrize("block", [8192, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    rng = np.random.default_rng(7)
    rows = [(i, np.float32(rng.normal(size=16)).tolist()) for i in range(300)]
    same = rows[10][1]
    rows += [(400 + i, same) for i in range(40)] + [(700, None), (701, [0.0] * 16), (702, [1.0, None] * 8), (703, [float("nan")] * 16), (704, [float("inf")] * 16), (None, same), (100, rows[5][1]), (20, same), (800, [1.0, 2.0]), (900, [1.0, 3.0]), (55, rows[55][1])]
    queries = [(i, v) for i, v in rows if i is not None and i % 10 == 0]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = [tuple(r) for r in ann.nearest(spark, df.where("vec_id % 10 = 0"), df, 5).collect()]
    assert sorted(got) == brute(rows, queries, 5)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 64)) * 10.0 ** rng.integers(-3, 3, (50, 1)), rng.normal(size=(70, 64))
    low, high = ann.bounds(ann.Quantised(a), ann.Quantised(b))
    d = np.sqrt(((a[:, None] - b) ** 2).sum(2))
    assert (low <= d).all() and (d <= high).all() and np.median(high - low) < 0.2 * np.median(d)


def test_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.nearest(spark, df.where("vec_id = 0"), df, 10).collect()] == [(0, 1, 1)]
    assert ann.nearest(spark, df.where("false"), df).count() == 0 and ann.nearest(spark, df, df.where("false")).count() == 0


def test_repeated_ids_do_not_hide_others():
    best = ann.Best(1, 2)
    best.add(np.zeros(2, int), np.array([8.0, 9.0]), np.array([1, 2]))
    best.add(np.zeros(31, int), np.append(np.full(30, 1.0), 2.0), np.append(np.full(30, 3), 4))
    assert best.rows[0] == [(1.0, 3), (2.0, 4)]
