import random
import re

import numpy as np
from pyspark.sql import functions as F

from colframe.llm import jaccard_join, linking


def brute(rows, k, share):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][0], rows[j][0]
            if a is None or b is None:
                continue
            if sets[i] and sets[j] and share[1] * len(sets[i] & sets[j]) >= share[0] * len(sets[i] | sets[j]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), root(d) if d is not None else None) for (d, _), s in zip(rows, sets)), key=repr)


def corpus():
    rng = random.Random(9)
    pool = [f"W{i}" for i in range(60)] + ["été", "É"]
    make = lambda n: [rng.choice(pool) for _ in range(n)]
    passage = make(30)
    base = [make(rng.choice([1, 2, 4, 5, 8, 15, 40, 120, 400])) for _ in range(40)]
    texts = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            p = rng.randrange(len(w) + 1)
            if rng.random() < 0.5:
                w[p:p] = make(1)
            elif len(w) > 1:
                del w[min(p, len(w) - 1)]
        if i % 9 == 0:
            w += passage
        texts.append(" ".join(w))
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    rows += [(5, None), (6, ""), (7, " \t\n"), (8, " \n"), (9, "W1"), (10, "w1 "), (11, "w1 w1"), (None, texts[0]), (rows[3][0], rows[3][1]), (rows[4][0], rows[70][1]), (12, "w " * 40000 + "x"), (13, "w " * 40001 + "x")]
    return rows


def test_components_against_brute_force(spark):
    rows = corpus()
    for k, share in ((4, (85, 100)), (5, (4, 5))):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)
        got = sorted((tuple(r) for r in jaccard_join.join(spark, df, k, share).collect()), key=repr)
        assert got == brute(rows, k, share)


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(3)
    for share in ((85, 100), (4, 5)):
        sizes = np.array([3, 10, 60, 300])
        plan = jaccard_join.bands(share, 1 << 12, sizes, 100_000)
        for _ in range(400):
            n = int(rng.choice([1, 2, 5, 6, 7, 11, 12, 30, 77, 200, 900]))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop, add = rng.integers(0, n // 6 + 1), rng.integers(0, n // 6 + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            common = np.unique(rng.choice(a, n // 3))
            if share[1] * both >= share[0] * (len(a) + len(b) - both):
                x, y = (jaccard_join.signatures(s, plan, share, common) for s in (a, b))
                assert len(np.intersect1d(x, y)), (n, drop, add)


def test_empty(spark):
    assert jaccard_join.join(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_more_partitions_than_cores(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    got = sorted((tuple(r) for r in jaccard_join.join(spark, df, 5, (4, 5)).collect()), key=repr)
    assert got == brute(rows, 5, (4, 5))


def test_a_hot_group_of_near_copies_needs_few_pairs(spark, monkeypatch):
    """Copies with edits, some of them too far from most others: brute force's components from pairs linear in members."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 999)}" for _ in range(150)]

    def near():
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        return " ".join(w)

    rows = [(i, near()) for i in range(400)]
    pairs, overlapping = [], linking.overlapping
    monkeypatch.setattr(linking, "overlapping", lambda some, sets, share: pairs.append(some.count()) or overlapping(some, sets, share))
    for chunk, parts in ((2048, 64), (16, 1)):  # small chunks: buckets are split
        monkeypatch.setattr(linking, "CHUNK", chunk)
        pairs.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((tuple(r) for r in jaccard_join.join(spark, df, 5, (4, 5)).collect()), key=repr)
        assert got == brute(rows, 5, (4, 5))
        assert sum(pairs) <= 12 * len(rows)


def test_label_rounds_equal_the_single_task(spark):
    from colframe.llm.common import Scratch

    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    df = Scratch(spark, "edges").save(spark.createDataFrame(edges, "a long, b long").repartition(5))
    few, many = (sorted(map(tuple, linking.connected(spark, Scratch(spark, "t"), df, x).collect())) for x in (True, False))
    assert few == many and dict(few)[60] == 0
    at = dict(few)
    assert all(at[a] == at[b] for a, b in edges) and all(at[c] == c for c in set(at.values()))


def test_copies_in_other_tasks_bring_no_buckets(spark, monkeypatch):
    """Only a content's first node has its signatures bucketed; a copy without a doc_id takes none from the others."""
    rng = random.Random(9)
    text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(120))
    alone = " ".join(f"z{rng.randint(0, 999)}" for _ in range(120))
    near = alone.rsplit(" ", 1)[0] + " other"
    rows = [(None, alone), (90, alone), (91, near)] + [(i, text) for i in range(40)]
    counts, once = [], linking.once
    monkeypatch.setattr(linking, "once", lambda scratch, members: counts.append(members.select("node").distinct().count()) or once(scratch, members))
    one, many = (spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(rows, "doc_id long, text string").repartition(20))
    for df in (one, many):
        counts.clear()
        got = {r.doc_id: r.component_id for r in jaccard_join.join(spark, df, 4, (85, 100)).collect()}
        assert got == {None: None, 90: 90, 91: 90} | {i: 0 for i in range(40)}
        assert counts == [2]


def test_a_sketch_is_sent_once_for_buckets_with_the_same_nodes(spark, monkeypatch):
    """Forty buckets of the same twelve nodes and one more each: their rows share the twelve sketches."""
    from colframe.llm.common import Scratch

    rng, scratch = np.random.default_rng(8), Scratch(spark, "t")
    rows = [(s, v) for s in range(40) for v in [*range(12), 100 + s]]
    nodes = sorted({v for _, v in rows})
    members = scratch.save(spark.createDataFrame(rows, "sig long, node long"))
    sketches = scratch.save(spark.createDataFrame([(v, 100, rng.bytes(64)) for v in nodes], "node long, n long, sketch binary"))
    frame, sent = type(members), []
    deal = frame.repartition

    def counted(self, *columns):
        if "sketch" in self.columns:
            sent.append(self.where("sketch is not null").count())
        return deal(self, *columns)

    monkeypatch.setattr(frame, "repartition", counted)
    labels = linking.link(spark, scratch, members, lambda pairs: pairs, None, sketches, (4, 5)).collect()
    assert sorted(map(tuple, labels)) == [(v, v) for v in nodes]
    assert sent and max(sent) < len(rows) // 2
