"""Toxicity by multiple-instance learning: labels are per document, what is learned is a score per sentence.

A sentence's probability is logistic in hashed features of its words (the word and its first 4, 5 and 6 letters).
A document is toxic if any sentence is: P = 1 - prod(1 - p_sentence), the noisy-or, and the gradient of the document
loss flows through it to sentences. The same sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colframe.llm.common import ship

#: A sentence ends at these marks or at a line's end.
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
BITS = 18
PREFIXES = (4, 5, 6)


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word."""
    names = {word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)}
    return sorted({crc32(n.encode()) & ((1 << BITS) - 1) for n in names})


class WordScores(dict):
    """word -> sum of its features' weights, most entries at most."""

    def __init__(self, weights: np.ndarray, most: int = 400_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        v = float(self.weights[features(word)].sum())
        if len(self) >= self.most:
            self.clear()
        self[word] = v
        return v


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, text: str, scores: WordScores) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans of the sentences that have words, and their log odds."""
        spans, z = [], []
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m[0].lower()))
            if words:
                spans.append(m.span())
                z.append(self.bias + sum(map(scores.__getitem__, words)))
        return spans, np.array(z)


def noisy_or(z: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(z)); 0 without sentences."""
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def fit(labels: np.ndarray, of_sentence: np.ndarray, feature: np.ndarray, docs_of: np.ndarray, epochs: int = 60, rate: float = 0.5, shrink: float = 0.02, at_least: int = 4) -> Model:
    """Full-batch Adagrad on the noisy-or likelihood, both classes weighing the same.

    labels by document; docs_of: document of each sentence; of_sentence and feature: one entry for each feature of a
    sentence. Features in fewer than at_least documents are left out; weights are shrunk towards 0 (L1).
    """
    pairs = np.unique(docs_of[of_sentence].astype(np.int64) << BITS | feature)
    common = np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS) >= at_least
    used = common[feature]
    of_sentence, feature = of_sentence[used], feature[used]
    names, at = np.unique(feature, return_inverse=True)
    w, b = np.zeros(len(names)), -8.0
    squares, square_b = np.full(len(names), 1e-4), 1e-4
    n, y = len(labels), labels.astype(float)
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(epochs):
        z = b + np.bincount(of_sentence, w[at], len(docs_of))
        s = np.bincount(docs_of, np.logaddexp(0, z), n)
        slope = balance * (1 - y - y / np.maximum(np.expm1(np.minimum(s, 50)), 1e-6))
        g = np.clip(slope[docs_of], -1, 1) / (1 + np.exp(-np.clip(z, -50, 50)))
        gw, gb = np.bincount(at, g[of_sentence], len(names)), g.sum()
        squares += gw**2
        square_b += gb**2
        step = rate / np.sqrt(squares)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink * 1e-2, 0)
        b -= 0.2 * gb / np.sqrt(square_b)
    weights = np.zeros(1 << BITS)
    weights[names] = w
    return Model(weights, float(b))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2500, 1500)) -> Model | None:
    """Fits the model on docs(doc_id, text) joined with labels(doc_id, toxic); None unless both classes have rows.

    The classifier is fitted on a bounded sample: about per_class[toxic] labelled documents of each class, by a hash
    of doc_id. Rows with a null doc_id, label or text are left out; of several labels of a document the largest holds.
    """
    ship(spark)
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, per_class[1] / sizes[1])).otherwise(min(1.0, per_class[0] / sizes[0]))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) < share * (1 << 20))
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # bounded: the sample

    def extract(batches):
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                sentences = [[f for w in set(WORD.findall(m.lower())) for f in features(w)] for m in SENTENCE.findall(text)]
                sentences = [s for s in sentences if s]
                rows.append((toxic, np.array([len(s) for s in sentences], np.int32).tobytes(), np.array([f for s in sentences for f in s], np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["toxic", "sizes", "features"])

    got = sample.select("text", "toxic").mapInArrow(extract, "toxic int, sizes binary, features binary").toArrow()
    labels_ = got.column("toxic").to_numpy()
    if len(set(labels_.tolist())) < 2:
        return None
    sizes_ = [np.frombuffer(x, np.int32) for x in got.column("sizes").to_pylist()]
    docs_of = np.repeat(np.arange(len(sizes_)), [len(x) for x in sizes_])
    lengths = np.concatenate(sizes_)
    return fit(labels_, np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.frombuffer(x, np.int32) for x in got.column("features").to_pylist()]), docs_of)


def score(spark: SparkSession, docs: DataFrame, model: Model | None, offending: float = 0.5) -> DataFrame:
    """docs with score, n_sentences and offending added; all rows stay, repeated rows too, and only text is read.

    offending: the sentences of probability ``offending`` or more (start and end in characters, probability), worst
    first. Null and empty texts, and all texts without a model, have score 0. Columns with these names are replaced.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    new = ("score", "n_sentences", "offending")
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept).schema.add("score", "double").add("n_sentences", "long").add("offending", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("p", "double")))

    def run(batches):
        m = shared.value
        cache = WordScores(m.weights) if m else None
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            score_, n, found = [], [], []
            for text in batch.column("text"):
                at, z = m.sentences(text.as_py() or "", cache) if m else ([], np.empty(0))
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                worst = [i for i in np.argsort(-p, kind="stable") if p[i] >= offending]
                score_.append(noisy_or(z))
                n.append(len(at))
                found.append([{"start": at[i][0], "end": at[i][1], "p": float(p[i])} for i in worst])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_, pa.float64()), pa.array(n, pa.int64()), pa.array(found, kind)], [*batch.schema.names, *new])

    return docs.select(*kept).mapInArrow(run, schema)
