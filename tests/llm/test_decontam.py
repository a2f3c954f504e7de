import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from colframe.llm import decontam


def brute(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).add(i)
    sizes, out = {len(x) for x in wins}, []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    ids |= {x for x in found if x is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return out


def cases():
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(40)] + ["É", "été", "don't", "x-y", "Q"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.choice([10, 11, 25, 40]))) for i in range(30)] + [(50, None), (51, "... !"), (None, "no id " * 6), (7, "again the seventh one with some more words than ten here")]
    docs = []
    for i in range(120):
        t = text(rng.randint(0, 60))
        if i % 3 == 0:
            w = (rng.choice(items[:30])[1]).split()
            a = rng.randrange(len(w))
            t = t + " " + " ".join(w[a : a + rng.randint(8, 30)]).upper().replace("É", "é") + "\n" + text(5)
        docs.append((i, t))
    docs += [(900, None), (901, ""), (902, items[0][1] + " w1" * 30000 + " " + items[1][1]), (3, docs[3][1]), (3, "another text"), (None, items[2][1])]
    return docs, items


@pytest.mark.parametrize("short", [False, True])
def test_against_brute_force(spark, short):
    docs, items = cases()
    if short:
        items = items + [(60, "w3 Q"), (61, "w5"), (62, "w1 w2 w3 w4 w5 w6 w7")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = [tuple(r) for r in decontam.decontaminate(spark, d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_shuffled_joins_agree(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(decontam, "BOUND", 0)
    got = decontam.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(repr, map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))) == sorted(map(repr, brute(docs, items)))


def test_empty_tables(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.decontaminate(spark, d.where("false"), b).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(spark, d, b.where("false")).collect())
