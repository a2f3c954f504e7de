import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from colframe.llm import classlm
from colframe.llm.common import Scratch, fold


def texts():
    rng, kinds = random.Random(4), ["the a of".split(), "dog cat Bird".split(), "runs eats\tsleeps".split(" "), "odd{} é{} x{}".split()]
    out = [" ".join(rng.choice(kinds[i % 4]).format(rng.randint(0, 300)) for i in range(rng.randint(1, 60))) for _ in range(300)]
    return out + [None, "", " \n ", "never seen words zzz", "dup row", "dup row"]


def brute(rows):
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [0]
    train = Counter(w for i, t in rows if crc32(str(i).encode()) % 10 for w in tok(t))
    n, v = sum(train.values()), len(train)
    return {i: (len(tok(t)), sum(w in train for w in tok(t)), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t))) for i, t in rows}


@pytest.mark.parametrize("head", [5, 100_000])
def test_base_score_against_brute_force(spark, head):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("held_out", fold("doc_id", 10) == 0)
    got = classlm.score(spark, df, head=head, frequent=4, groups=8, classes=6).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], abs=1e-6) and r.held_out == (crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in got if r.held_out]
    if head > 5:
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    pairs = np.zeros((9, 9))
    seq = [8] + [rng.integers(4) + 4 * (i % 2) for i in range(4000)] + [8]
    np.add.at(pairs, (seq[:-1], seq[1:]), 1)
    of = classlm.exchange(pairs, 3, 8)
    assert len(set(of[:4])) == 1 and len(set(of[4:8])) == 1 and of[0] != of[4] and of[8] == 0


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, True, "a b"), (None, False, None)], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r for r in classlm.score(spark, df).collect()}
    assert got[1].train_tokens == 0 and got[1].n_tokens == 3 and got[1].n_known == 0 and math.isfinite(got[1].score) and got[None].n_tokens == 1
    assert classlm.score(spark, df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("head", [5, 100_000])
def test_score_against_a_naive_model(spark, head):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", fold("doc_id", 10) == 0).withColumn("codes", F.lit("clash")).withColumn("row", F.lit(1)).repartition(20)
    options = dict(frequent=4, groups=8, classes=6)
    got = {r.doc_id: r for r in classlm.score(spark, df, head=head, **options).collect()}
    train = df.where("not held_out").select(F.col("text").cast("binary").alias("text"))
    m = classlm.Model(spark, train, Scratch(spark, "test"), 100_000, **options)
    of = {w: int(m.units.of[i]) for w, i in m.units.index.items()}
    tok = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    learned = [tok(t) for i, t in rows if crc32(str(i).encode()) % 10]
    assert set(of) == {w for t in learned for w in t} and 0 not in of.values()
    sequence = lambda words: [0, *(of[w] if w in of else int(m.units.endings[crc32(w[-3:]) % 8]) for w in words), 0]
    n = Counter(w for t in learned for w in t)
    table, mass = np.zeros((6, 6)), np.zeros(6)
    for t in learned:
        for a, b in zip(sequence(t), sequence(t)[1:]):
            table[a, b] += 1
    for w, k in n.items():
        mass[of[w]] += k + 0.1
    mass[0] += len(learned) + 0.1
    p = np.maximum(mass, 1e-9) / np.maximum(mass, 1e-9).sum()
    given = (table + 50 * p) / (table.sum(1, keepdims=True) + 50)
    for i, t in rows:
        s = sequence(tok(t))
        want = got[i].base_score + sum(math.log10(0.9 * given[a, b] / p[b] + 0.1) for a, b in zip(s, s[1:]))
        assert got[i].score == pytest.approx(want, abs=1e-9)


def test_every_other_word_goes_to_its_likeliest_class(spark):
    rng = random.Random(8)
    words = [t.split() for t in (" ".join(rng.choice(["a", "b", "c", "w1", "w2", "w3", "é4"]) for _ in range(rng.randint(0, 30))) for _ in range(200))]
    units = classlm.Units(groups=3, frequent=3, index={b"a": 0, b"b": 1, b"c": 2})
    of, given, p = np.array([1, 2, 1, 2, 1, 2, 0]), np.array([[0.2, 0.5, 0.3], [0.1, 0.3, 0.6], [0.3, 0.6, 0.1]]), np.array([0.2, 0.5, 0.3])
    df = spark.createDataFrame([(" ".join(t).encode(),) for t in words], "text binary").repartition(7)
    got = {r.word: (r.n, r["class"]) for r in classlm.assign(spark, df, units, of, given, p, most=10).collect()}
    unit = lambda w: {"a": 0, "b": 1, "c": 2}.get(w, 3 + crc32(w.encode()[-3:]) % 3)
    want = {}
    for w in ("w1", "w2", "w3", "é4"):
        gain, n = [-math.inf] + [0.0] * 2, 0
        for t in words:
            c = [0, *(of[unit(x)] for x in t), 0]
            for i, x in enumerate(t, 1):
                if x == w:
                    n += 1
                    for k in (1, 2):
                        gain[k] += math.log(given[c[i - 1], k]) + math.log(given[k, c[i + 1]]) - math.log(p[k])
        want[w.encode()] = (n, int(np.argmax(gain)))
    assert {w: (n, k) for w, (n, k) in got.items()} == want


def test_very_long_text_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    df = spark.createDataFrame([(1, False, long), (1, False, long), (2, False, "w1 w2"), (3, True, long)], "doc_id long, held_out boolean, text string")
    got = classlm.score(spark, df, head=10, frequent=4, groups=8, classes=6).collect()
    assert sorted(r.n_tokens for r in got) == [3, 70_001, 70_001, 70_001] and all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in got)
