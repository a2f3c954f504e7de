import numpy as np
from pyspark.sql import functions as F

from colframe.llm import langid

EN = "the quick brown fox jumps over the lazy dog while thinking of nothing but the weather there"
FR = "le garçon était très content de voir où la rivière coulait à travers les forêts dorées"


def train_rows():
    out = []
    for i in range(40):
        for x, t in (("en", EN), ("fr", FR)):
            w = t.split()
            out.append((len(out), " ".join(w[i % 5 :] + w[: i % 5]), x))
    return out + [(900, None, "en"), (901, "zzz", None), (None, FR, "fr")]


def test_identify(spark):
    model = langid.train(spark, spark.createDataFrame(train_rows(), "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"] and (model.rates < 0.05).all()
    rows = [(1, "the weather over there"), (2, "LA RIVIÈRE DORÉE"), (3, None), (4, ""), (5, "123 \n ..."), (6, "中文"), (7, EN * 5000), (1, "the weather over there")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(5))
    got = langid.identify(spark, df, model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["en", "en", "fr", "und", "und", "und", "fr", "en"]  # no known n-gram: the most frequent
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)


def test_masks_hold_every_language_of_an_ngram():
    h, of = langid.grams(["ab, é", "", "x"])
    assert of.tolist() == [0, 0, 0, 2] and len(set(h.tolist())) == 4
    m = langid.Model(["a", "b"], np.zeros((64, 1), np.uint64), np.zeros(2), 0)
    for at in m.where(h[:1]):
        np.bitwise_or.at(m.slots, (at, 0), np.uint64(3))
    assert m.contains(h[:1])[0, 0] == 3


def test_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train(spark, empty) is None
    assert langid.identify(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), None).first().lang_pred == "und"
    assert langid.identify(spark, empty, None).count() == 0


def test_decisions_against_naive_counts(spark):
    """Trigrams, filters and corrected counts by plain loops over characters."""
    import math
    import random

    model = langid.train(spark, spark.createDataFrame(train_rows(), "doc_id long, text string, lang string"))
    rng = random.Random(2)
    words = (EN + " " + FR).split() + ["zzqx", "42", "É,"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", "1 2", "é"]

    def inside(gram, i):
        a, b, c = (0 if x == " " else ord(x) for x in gram)
        h = int(langid.mix(np.array([((a << 42) | (b << 21) | c) + 1], np.uint64))[0])
        size = len(model.slots)
        return all((int(model.slots[at % size, i // 64]) >> (i % 64)) & 1 for at in (h, h >> 32))

    best, score, cover = model.decide(texts)
    for t, got, s, k in zip(texts, best, score, cover):
        low = "".join(x if x.isalpha() else " " for x in t.lower())
        grams = [f" {w} "[j : j + 3] for w in low.split() for j in range(len(w))]
        counts = [max(0.0, (sum(inside(g, i) for g in grams) - len(grams) * model.rates[i]) / (1 - model.rates[i])) for i in range(2)]
        top = counts.index(max(counts)) if sum(counts) else model.fallback
        assert got == (top if grams else -1)
        if grams and sum(counts):
            assert math.isclose(s, counts[top] / sum(counts), abs_tol=1e-9) and math.isclose(k, min(1.0, counts[top] / len(grams)), abs_tol=1e-9)
