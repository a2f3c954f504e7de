"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language is stored bit-sliced: a slot holds one bit for each language, so the AND of an n-gram's
slots is the set of all languages that contain it. Bits are counted per language over all n-grams of a text, the
counts are corrected by each filter's false positive rate, and the largest decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colframe.llm.common import lean, mix, ship

#: Characters that are handled in one piece of NumPy work.
CHUNK = 1 << 20
_alpha: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters (general category L)."""
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _alpha


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all letter trigrams, word edges included, and the index of each one's text (ascending).

    Runs of other characters are one edge; a trigram's middle is always a letter, so none spans two words or texts.
    """
    low = [f" {t.lower()} " for t in texts]
    x = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(low)), [len(t) for t in low])
    is_letter = letters()[x]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:-1] |= is_letter[1:]
    x, of = np.where(is_letter, x, 0)[keep].astype(np.uint64), of[keep]
    middle = np.flatnonzero(x[1:-1]) + 1
    code = (x[middle - 1] << np.uint64(42)) | (x[middle] << np.uint64(21)) | x[middle + 1]
    with np.errstate(over="ignore"):
        return mix(code + np.uint64(1)), of[middle]


def chunks(texts: list[str]):
    """Slices of the list with about CHUNK characters each; a longer text is a slice of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


@dataclass
class Model:
    """languages in order; slots: (slots, words) uint64 masks; rates: false positive rate of each language's filter."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray
    fallback: int

    def where(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.uint64(len(self.slots) - 1)
        return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of all languages that contain it."""
        a, b = self.where(h)
        return self.slots[a] & self.slots[b]

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: language index (-1: no letter), score (share of the best among all corrected counts), coverage
        (corrected share of the text's n-grams that the best language contains)."""
        best, score, cover = (np.full(len(texts), v) for v in (-1, 0.0, 0.0))
        for a, b in chunks(texts):
            h, of = grams(texts[a:b])
            start, end = (np.searchsorted(of, np.arange(b - a), s) for s in ("left", "right"))
            n, masks = end - start, self.contains(h)
            counts = np.zeros((b - a, len(self.languages)))
            for i in range(len(self.languages)):
                bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                total = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
                counts[:, i] = total[end] - total[start]
            counts = np.clip((counts - n[:, None] * self.rates) / (1 - self.rates), 0, None)
            top, sums = counts.argmax(1), counts.sum(1)
            top = np.where(sums > 0, top, self.fallback)
            value = counts[np.arange(b - a), top]
            best[a:b] = np.where(n > 0, top, -1)
            score[a:b] = np.clip(value / np.where(sums > 0, sums, 1), 0, 1)
            cover[a:b] = np.clip(value / np.maximum(n, 1), 0, 1)
        return best, score, cover


def train(spark: SparkSession, labelled: DataFrame, per_language: int = 2000, ratio: float = 0.3, at_least: int = 2) -> Model | None:
    """Fits filters on labelled(doc_id, text, lang), rows with null text or lang apart; None if no row is left.

    The classifier is fitted on a bounded sample: about per_language rows of each language, chosen by a hash of
    doc_id and text. An n-gram is put into a language's filter if it occurs at_least times in it and its relative
    frequency is at least ratio times that in the language where it is most frequent.
    """
    ship(spark)
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    rate = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, per_language / sizes[x]))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 20)) < F.try_element_at(rate, F.col("lang")) * (1 << 20))

    def count(batches):
        for batch in batches:
            lang, text = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for x in sorted(set(lang)):
                own = [t for t, y in zip(text, lang) if y == x]
                for a, b in chunks(own):
                    h, n = np.unique(grams(own[a:b])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    share = counted.join(F.broadcast(totals), "lang").withColumn("p", F.col("n") / F.col("all"))
    kept = share.withColumn("top", F.max("p").over(Window.partitionBy("gram"))).where((F.col("n") >= at_least) & (F.col("p") >= ratio * F.col("top")))
    got = kept.select("lang", "gram").toArrow()
    h = got.column("gram").to_numpy().view(np.uint64)
    index = {x: i for i, x in enumerate(languages)}
    lang = np.array([index[x] for x in got.column("lang").to_pylist()], np.int64)
    slots = np.zeros((1 << max(12, int(np.ceil(np.log2(8 * len(h) + 1)))), (len(languages) + 63) // 64), np.uint64)
    model = Model(languages, slots, np.zeros(len(languages)), max(range(len(languages)), key=lambda i: sizes[languages[i]]))
    for at in model.where(h):
        np.bitwise_or.at(slots, (at, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
    fill = np.array([((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    model.rates = np.minimum(fill**2, 0.99)
    return model


def identify(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and coverage added; all rows stay and only text is read.

    A null text or one without a letter is ``und`` with score 0, and so is every text if there is no model. A text
    with letters but without a known n-gram gets the most frequent language with score 0. Equal counts go to the
    first language in order. Columns of docs with these names are replaced.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "coverage")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("coverage", "double")

    def predict(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, score, cover = m.decide(texts) if m else (np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)))
            names = pa.array([m.languages[i] if i >= 0 else "und" for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(score), pa.array(cover)], [*batch.schema.names, "lang_pred", "score", "coverage"])

    return docs.select(*kept).mapInArrow(lean(predict), schema)
