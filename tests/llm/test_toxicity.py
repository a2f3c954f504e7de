import random

import pytest
from pyspark.sql import functions as F

from colframe.llm import toxicity


def corpus(n=400):
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in "ka mo ri tu se na".split() for b in "lor vin dak pel".split()]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        sentences = [" ".join(rng.choice(plain) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 12))]
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["grumbex", "grumbextor", "Grumbexes"])
        docs.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    return toxicity.train(spark, spark.createDataFrame(docs[:300], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_documents_and_places(spark, model):
    docs, labels = corpus()
    rows = docs[300:] + [(1000, None), (1001, ""), (1002, "Grumbex! " + "kalor movin. " * 5000), (1003, "kalor " * 20000), (301, docs[301][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = toxicity.score(spark, df, model).collect()
    assert len(got) == len(rows)
    want = dict(labels[300:])
    right = [(r.score >= 0.7) == bool(want[r.doc_id]) for r in got if r.doc_id < 1000]
    assert sum(right) >= 0.97 * len(right)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id < 1000 and want[r.doc_id] and r.score >= 0.7:
            s = r.offending[0]
            assert "grumbex" in r.text[s.start : s.end].lower()
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == 0 and by[1000].n_sentences == 0
    assert by[1002].score > 0.9 and by[1002].offending[0].start == 0 and by[1003].score < 0.7


def test_noisy_or():
    import numpy as np

    z = np.array([-1.0, 0.5, -3.0])
    p = 1 / (1 + np.exp(-z))
    assert toxicity.noisy_or(z) == pytest.approx(1 - np.prod(1 - p)) and toxicity.noisy_or(np.empty(0)) == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (1, 0)], "doc_id long, toxic int")
    assert toxicity.train(spark, docs, none) is None
    assert [r.score for r in toxicity.score(spark, docs, None).collect()] == [0.0, 0.0]
    assert toxicity.score(spark, docs.where("false"), None).count() == 0


def test_fit_and_scores_against_naive_loops():
    """The noisy-or's gradient and Adagrad, one number at a time, and a text's score from its sentences' words."""
    import math

    import numpy as np

    docs, labels = corpus(60)
    sentences, feature, of_sentence, docs_of = [], [], [], []
    for i, text in docs:
        for m in toxicity.SENTENCE.findall(text):
            words = set(toxicity.WORD.findall(m.lower()))
            if words:
                own = [f for w in sorted(words) for f in toxicity.features(w)]
                feature += own
                of_sentence += [len(sentences)] * len(own)
                docs_of.append(i)
                sentences.append(own)
    y = [v for _, v in labels]
    epochs, rate, shrink = 5, 0.5, 0.02
    got = toxicity.fit(np.array(y), np.array(of_sentence), np.array(feature), np.array(docs_of), epochs=epochs, rate=rate, shrink=shrink, at_least=4)
    seen = {}
    for own, d in zip(sentences, docs_of):
        for f in own:
            seen.setdefault(f, set()).add(d)
    w, b = {f: 0.0 for f, ds in seen.items() if len(ds) >= 4}, -8.0
    squares, square_b = dict.fromkeys(w, 1e-4), 1e-4
    for _ in range(epochs):
        z = [b + sum(w.get(f, 0.0) for f in own) for own in sentences]
        none = {}  # log of the probability that no sentence of a document is toxic
        for v, d in zip(z, docs_of):
            none[d] = none.get(d, 0.0) - math.log1p(math.exp(v))
        g, gb = dict.fromkeys(w, 0.0), 0.0
        for v, d, own in zip(z, docs_of, sentences):
            balance = 0.5 / y.count(y[d])
            # d loss / d z: p for a clean document, -p (1 - P) / P for a toxic one
            p, left = 1 / (1 + math.exp(-v)), math.exp(none[d])
            slope = balance * (1.0 if not y[d] else 1 - 1 / max(1 - left, 1e-12))
            slope = max(-1.0, min(1.0, slope)) * p
            gb += slope
            for f in own:
                if f in g:
                    g[f] += slope
        for f in w:
            squares[f] += g[f] ** 2
            step = rate / math.sqrt(squares[f])
            w[f] -= step * g[f]
            w[f] = math.copysign(max(abs(w[f]) - step * shrink * 1e-2, 0.0), w[f])
        square_b += gb**2
        b -= 0.2 * gb / math.sqrt(square_b)
    assert got.bias == pytest.approx(b, abs=1e-6)
    for f, v in w.items():
        assert got.weights[f] == pytest.approx(v, abs=1e-6)
    cache = toxicity.WordScores(got.weights, most=10)
    for _, text in docs[:20]:
        _, z = got.sentences(text, cache)
        clean = 1.0
        for m in toxicity.SENTENCE.findall(text):
            words = set(toxicity.WORD.findall(m.lower()))
            if words:
                clean *= 1 - 1 / (1 + math.exp(-(got.bias + sum(got.weights[f] for x in words for f in toxicity.features(x)))))
        assert toxicity.noisy_or(z) == pytest.approx(1 - clean, abs=1e-9)
