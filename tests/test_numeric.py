"""Queries that SQL can't express, computed another way over the same whole tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from colframe.plans import catalog

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def vectors():
    t = pq.read_table(f"{SF}/embeddings.parquet").sort_by("vec_id")
    return np.array(t.column("embedding").to_pylist(), np.float64), np.array(t.column("label").to_pylist())


def test_singular_values_of_the_table(spark):
    got = np.array([r.s for r in sorted(run(spark, "singular_values"), key=lambda r: r.i)])
    assert got == pytest.approx(np.linalg.svd(vectors()[0], compute_uv=False), abs=2e-6)


def test_conjugate_gradient_of_the_table(spark):
    x, _ = vectors()
    got = np.array([r.v for r in sorted(run(spark, "conjugate_gradient"), key=lambda r: r.i)])
    assert got == pytest.approx(np.linalg.solve(x.T @ x + np.eye(64), np.ones(64)), abs=2e-4)


def test_filtfilt_of_the_table(spark):
    """Against the steady-state response: both passes as dense lower-triangular products."""
    t = pq.read_table(f"{SF}/events.parquet").to_pandas()
    b, a = [0.20657208382614792, 0.41314416765229584, 0.20657208382614792], [1.0, -0.36952737735124147, 0.1958157126558333]
    got = {}
    for r in run(spark, "filtfilt"):
        got.setdefault(r.user_id, {})[r.k] = r.y

    def one_pass(x):
        y, first = [], x[0]  # the filter has seen the first value for ever, and its gain there is 1
        past, out = [first, first], [first, first]
        for v in x:
            w = b[0] * v + b[1] * past[0] + b[2] * past[1] - a[1] * out[0] - a[2] * out[1]
            past, out = [v, past[0]], [w, out[0]]
            y.append(w)
        return np.array(y)

    for user, g in t.sort_values("event_id").groupby("user_id"):
        x = g.value.to_numpy()
        edge = min(9, len(x) - 1)
        z = np.concatenate([2 * x[0] - x[1 : edge + 1][::-1], x, 2 * x[-1] - x[-edge - 1 : -1][::-1]]) if edge else x
        z = one_pass(one_pass(z)[::-1])[::-1]
        want = z[edge : len(z) - edge] if edge else z
        assert [got[user][k] for k in range(len(x))] == pytest.approx(want, abs=1e-3)


def test_training_of_the_table(spark):
    """The same network and optimiser, written out for one full batch."""
    from colframe.operators.neural import lcg_uniform

    x, label = vectors()
    y = label % 4
    w = lcg_uniform(64 * 8 + 4 * 8, 1, -0.5, 0.5)
    p = {"w": w[:512].reshape(8, 64).copy(), "a": np.zeros(8), "v": w[512:].reshape(4, 8).copy(), "c": np.zeros(4)}
    m, s = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    losses = []
    epochs = len(got := sorted(run(spark, "mlp_training"), key=lambda r: r.epoch))
    for t in range(1, epochs + 1):
        h = x @ p["w"].T + p["a"]
        z = np.maximum(h, 0) @ p["v"].T + p["c"]
        e = np.exp(z - z.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        losses.append(-np.log(e[np.arange(len(y)), y]).mean())
        e[np.arange(len(y)), y] -= 1
        e /= len(y)
        d = (e @ p["v"]) * (h > 0)
        grads = {"w": d.T @ x, "a": d.sum(0), "v": e.T @ np.maximum(h, 0), "c": e.sum(0)}
        for k, g in grads.items():
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
            p[k] = p[k] - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    assert [r.loss for r in got] == pytest.approx(losses, abs=1e-9) and losses[-1] < losses[0]


def test_transformer_of_the_table(spark):
    """Heads, masks and norms position by position."""
    import math

    from colframe.plans.learning import _layer

    def norm(v, w, b):
        m = sum(v) / len(v)
        s = math.sqrt(sum((a - m) ** 2 for a in v) / len(v) + 1e-5)
        return [(a - m) / s * c + e for a, c, e in zip(v, w, b)]

    def line(v, w, b):
        return [sum(a * c for a, c in zip(v, row)) + e for row, e in zip(w, b)]

    def attend(x, memory, p, causal=False):
        out = []
        for i, v in enumerate(x):
            q, joined = line(v, p["in_w"][:8], p["in_b"][:8]), []
            for h in range(2):
                part = slice(4 * h, 4 * h + 4)
                keys = [line(m, p["in_w"][8:16], p["in_b"][8:16])[part] for m in memory]
                values = [line(m, p["in_w"][16:], p["in_b"][16:])[part] for m in memory]
                e = [math.exp(sum(a * c for a, c in zip(q[part], k)) / 2) if not causal or j <= i else 0.0 for j, k in enumerate(keys)]
                joined += [sum(w * v[c] for w, v in zip(e, values)) / sum(e) for c in range(4)]
            out.append(line(joined, p["out_w"], p["out_b"]))
        return out

    plus = lambda x, y: [[a + b for a, b in zip(u, v)] for u, v in zip(x, y)]
    gelu = lambda a: 0.5 * a * (1 + math.tanh(math.sqrt(2 / math.pi) * (a + 0.044715 * a**3)))

    def feed(x, p, f):
        return [norm(r, p["n2w"], p["n2b"]) for r in plus(x, [line([f(a) for a in line(v, p["w1"], p["b1"])], p["w2"], p["b2"]) for v in x])]

    got = {r.vec_id: r.y for r in run(spark, "transformer")}
    vectors_, _ = vectors()
    assert len(got) == len(vectors_)
    a, b, c = _layer(11), _layer(12), _layer(13)
    for i in range(0, len(vectors_), 25):
        x = vectors_[i].reshape(8, 8).tolist()
        memory = feed([norm(r, a["n1w"], a["n1b"]) for r in plus(x, attend(x, x, a))], a, gelu)
        y = [norm(r, c["n1w"], c["n1b"]) for r in plus(x, attend(x, x, c, True))]
        y = [norm(r, b["n2w"], b["n2b"]) for r in plus(y, attend(y, memory, b))]
        want = feed(y, c, lambda v: max(v, 0.0))
        assert got[i] == pytest.approx([v for r in want for v in r], abs=2e-6)
