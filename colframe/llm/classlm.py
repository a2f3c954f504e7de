"""Class-based bigram language model over words, with classes from exchange clustering.

Unigram counts of every training token are exact. Exchange clustering assigns the most frequent words, and groups of
the others by ending, to classes so that adjacent classes tell most about each other. Then every other word is moved
to the class that raises the likelihood most, by the counts of all classes beside it in the corpus, so each word of
the training texts has a class of its own. With P(w) the smoothed unigram probability and P(c) the sum of its
members', a word's probability is

    P(w | previous) = P(w | c) * mixed(c | c_previous),
    P(w | c) = P(w) / P(c),  mixed = weight * P(c | c_previous) + (1 - weight) * P(c),

so a text's score is its unigram score plus a sum over class transitions. Workers hold the counts and classes of the
most frequent words; those of the others are joined.
"""

from __future__ import annotations

from collections import Counter
from itertools import compress, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import Scratch, elements, ship, slices

SMOOTHING = 0.1


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the class [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.split() cuts at just these bytes."""
    return text.lower().split() if text else []


def ending(word: bytes, groups: int) -> int:
    return crc32(word[-3:]) % groups


def count_words(train: DataFrame, groups: int, most: int = 300_000) -> DataFrame:
    """word, ending group and count over all training texts; tasks add up before the shuffle, most words at a time."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            names = list(seen)
            columns = [pa.array(names, pa.binary()), pa.array([ending(w, groups) for w in names], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            for a in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([c[a : a + 50_000] for c in columns], ["word", "ending", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > most:
                    yield from out()
        yield from out()

    return train.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int, fixed: int, sweeps: int = 6) -> np.ndarray:
    """Class of each unit, from the matrix of unit bigram counts; unit ``fixed`` keeps class 0 for itself.

    Each unit is moved to the class that raises the likelihood of the class bigram model most, until a sweep moves none.
    """
    n = len(pairs)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    of = np.zeros(n, np.int64)
    others = order[order != fixed]
    of[others] = 1 + np.arange(n - 1) % max(1, classes - 1)
    onehot = np.zeros((n, classes))
    onehot[np.arange(n), of] = 1
    table = onehot.T @ pairs @ onehot

    def f(x):
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = 0
        for u in others:
            a, own = of[u], pairs[u, u]
            right = np.bincount(of, pairs[u], classes)
            left = np.bincount(of, pairs[:, u], classes)
            right[a] -= own
            left[a] -= own
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            # wherever u goes, each class gets back what led to and followed u
            rows, columns, diagonal = table.sum(1) + left, table.sum(0) + right, np.diagonal(table)
            gain = (f(table + right) - f(table)).sum(1) + (f(table + left[:, None]) - f(table)).sum(0)
            gain -= f(diagonal + right) - f(diagonal) + f(diagonal + left) - f(diagonal)
            gain += f(diagonal + right + left + own) - f(diagonal)
            gain -= f(rows + right.sum() + own) - f(rows) + f(columns + left.sum() + own) - f(columns)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-6:
                b = int(a)
            table[b] += right
            table[:, b] += left
            table[b, b] += own
            moved += b != a
            of[u] = b
        if not moved:
            break
    return of


class Units:
    """What workers need of a model; it has no handle on tables."""

    def __init__(self, **values):
        self.__dict__.update(values)

    def find(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def units(self, words: list[bytes], cache: UnitOf) -> np.ndarray:
        """Unit of each word: its own for a frequent one, its ending's for others; the end's comes last."""
        out = np.empty(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        out[-1] = self.frequent + self.groups
        return out


class UnitOf(dict):
    """word -> unit, each word worked out once; it holds ``most`` words at most."""

    def __init__(self, units: Units, most: int = 300_000):
        super().__init__(units.index)
        self.of, self.most = units, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most + len(self.of.index):
            self.clear()
            self.update(self.of.index)
        self[word] = unit = self.of.frequent + ending(word, self.of.groups)
        return unit


class Numbers(dict):
    """word -> number, in the order in which words are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def unit_pairs(spark: SparkSession, train: DataFrame, units: Units) -> np.ndarray:
    """Counts of adjacent units over all training texts; each task sends its own nonzero counts."""
    size, shared = units.frequent + units.groups + 1, spark.sparkContext.broadcast(units)

    def count(batches):
        m = shared.value
        cache, total = UnitOf(m), np.zeros(size * size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                u = m.units(tokens(text.as_py()), cache)
                np.add.at(total, np.concatenate([[size - 1], u[:-1]]) * size + u, 1)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 100_000):
            some = at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pair", "n"])

    summed = train.select("text").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[summed.column("pair").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(size, size)


def transitions(table: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(class | previous class) from counts, smoothed by P(class), and P(class) from the classes' unigram mass."""
    p = np.maximum(mass, 1e-9)
    p = p / p.sum()
    return (table + 50 * p) / (table.sum(1, keepdims=True) + 50), p


def best_classes(beside: np.ndarray, given: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most, for words with counts of classes before and behind them (2 k columns).

    A word of class c costs log P(c) each time, since P(w | c) = P(w) / P(c). Class 0 is the end's own.
    """
    k = len(p)
    left, right = beside[:, :k], beside[:, k:]
    gain = left @ np.log(given) + right @ np.log(given).T - left.sum(1, keepdims=True) * np.log(p)
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def assign(spark: SparkSession, train: DataFrame, units: Units, of: np.ndarray, given: np.ndarray, p: np.ndarray, most: int = 300_000) -> DataFrame:
    """(word, n, class) of all words of the training texts but the frequent ones; of: classes of the units.

    Tasks count the classes beside each word and send a row a word, about ``most`` words at a time; rows of a word meet
    in one task, which adds them up as they come and holds one word's counts.
    """
    k, shared = len(p), spark.sparkContext.broadcast((units, of, given, p))

    def count(batches):
        m, of, *_ = shared.value
        cache, number, keys, fresh = UnitOf(m), Numbers(), [], 0

        def add_up():
            """Counted so far: word number * 2 k + class before (or k + class behind), with how often."""
            key, n = np.concatenate([x for x, _ in keys]), np.concatenate([x for _, x in keys])
            key, at = np.unique(key, return_inverse=True)
            return [(key, np.bincount(at, n, len(key)).astype(np.int64))]

        def out():
            (key, n), names = add_up()[0], list(number)
            start = np.searchsorted(key, np.arange(len(names) + 1) * 2 * k)
            codes, n = (key % (2 * k)).astype(np.uint8), n.astype(np.uint32)
            for a in range(0, len(names), 20_000):
                cut = start[a : a + 20_001]
                some = slice(cut[0], cut[-1])
                offsets = pa.array((cut - cut[0]).astype(np.int32))
                columns = [pa.array(names[a : a + 20_000], pa.binary())]
                for x, width in ((codes, 1), (n, 4)):
                    ends = pa.array(((cut - cut[0]) * width).astype(np.int32))
                    columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, ends.buffers()[1], pa.py_buffer(x[some].tobytes())]))
                yield pa.RecordBatch.from_arrays(columns, ["word", "codes", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                c = of[u := m.units(words, cache)]
                tail = u[:-1] >= m.frequent
                at = np.flatnonzero(tail)
                own = np.fromiter(map(number.__getitem__, compress(words, tail)), np.int64, len(at)) * 2 * k
                keys.append((np.concatenate([own + np.concatenate([c[-1:], c[:-1]])[at], own + k + c[at + 1]]), np.ones(2 * len(at), np.int64)))
                fresh += 2 * len(at)
                if fresh > 10 * most:
                    keys, fresh = add_up(), 0
                if len(number) > most or not fresh and keys and len(keys[0][0]) > 8 * most:
                    yield from out()
                    number.clear()
                    keys, fresh = [], 0
        if number:
            yield from out()

    def settle(batches):
        _, _, given, p = shared.value
        last, held = None, np.zeros((1, 2 * k))

        def send(words, beside):
            n = beside[:, :k].sum(1).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(best_classes(beside, given, p).astype(np.int32))], ["word", "n", "class"])

        for batch in batches:
            if not len(batch):
                continue
            words = batch.column("word").to_pylist()
            (codes, size), (n, _) = elements(batch.column("codes"), np.uint8), elements(batch.column("n"), np.uint32)
            new = [True, *map(bytes.__ne__, words[1:], words[:-1])]
            if words[0] == last:
                new[0] = False
            names = [w for w, x in zip(words, new) if x]
            row = np.cumsum(new)  # row 0 is the word that came before this batch
            beside = np.zeros((len(names) + 1, 2 * k))
            beside[0] = held
            np.add.at(beside.reshape(-1), np.repeat(row, size) * 2 * k + codes, n)
            if last is not None:
                names = [last, *names]
            else:
                beside = beside[1:]
            last, held = names[-1], beside[-1]
            if len(names) > 1:
                yield send(names[:-1], beside[:-1])
        if last is not None:
            yield send([last], held[None])

    rows = train.select("text").mapInArrow(count, "word binary, codes binary, n binary")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(settle, "word binary, n long, class int")


class Model:
    """Counts and classes of all words of the training texts: the ``least`` most frequent here, the others in a table."""

    def __init__(self, spark: SparkSession, train: DataFrame, scratch: Scratch, head: int, frequent: int, groups: int, classes: int):
        counts = scratch.save(count_words(train, groups))
        n, v = counts.agg(F.sum("n"), F.count("*")).first()
        ends = train.count()
        self.total, self.types = (n or 0) + ends, v + (ends > 0)
        self.denominator = self.total + SMOOTHING * (self.types + 1)
        self.least = self._threshold(counts, head)
        top = counts.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
        words, n, group = (top.column(c).to_numpy(zero_copy_only=False) for c in ("word", "n", "ending"))
        units = Units(groups=groups, frequent=len(words), index={w: i for i, w in enumerate(words)})
        end = units.frequent + groups
        pairs = unit_pairs(spark, train, units)
        of = exchange(pairs, classes, end)
        onehot = np.zeros((len(pairs), classes))
        onehot[np.arange(len(pairs)), of] = 1
        given, p = transitions(onehot.T @ pairs @ onehot, onehot.T @ np.maximum(pairs.sum(0), SMOOTHING))
        self.words = scratch.save(assign(spark, train, units, of, given, p))
        self.mass = np.zeros(classes)
        np.add.at(self.mass, of[: len(words)], n + SMOOTHING)
        for r in self.words.groupBy("class").agg((F.sum("n") + SMOOTHING * F.count("*")).alias("m")).collect():  # a row for each class
            self.mass[r["class"]] += r.m
        self.mass[of[end]] += ends + SMOOTHING
        more = self.words.where(F.col("n") >= self.least).toArrow()
        own = [*words, *more.column("word").to_pylist()]
        n = np.concatenate([n, more.column("n").to_numpy()])
        self.units = Units(
            groups=groups,
            index={w: i for i, w in enumerate(own)},
            log=np.log10((n + SMOOTHING) / self.denominator),
            of=np.concatenate([of[: len(words)], more.column("class").to_numpy()]).astype(np.int64),
            end_log=float(np.log10((ends + SMOOTHING) / self.denominator)),
            endings=of[units.frequent : end],
            classes=classes,
        )

    @staticmethod
    def _threshold(counts: DataFrame, head: int) -> int:
        """The smallest count that at most ``head`` words reach."""
        sizes = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
        at, seen = (1 << 16) + 1, 0
        for r in sizes:  # 65536 rows at most
            seen += r.words
            if seen > head:
                break
            at = r.n
        return at


def score(spark: SparkSession, docs: DataFrame, head: int = 200_000, frequent: int = 1024, groups: int = 256, classes: int = 64, weight: float = 0.9) -> DataFrame:
    """Scores every row of docs(doc_id, held_out, text); rows with held_out false and a doc_id are the training texts.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. All counts are over all training
    texts, and every word of them has a class: ``frequent`` words by exchange sweeps together with ``groups`` word
    endings, the others by their own counts. ``head`` bounds only the words that workers keep in memory; counts and
    classes of the others are joined, a row for each such word of a text. A word that no training text has gets the
    class of its ending. Null and empty texts are the end token alone; repeated rows are scored each; without training
    rows all counts are 0; other columns of docs are not read.
    """
    ship(spark)
    scratch = Scratch(spark, "classlm")
    docs = docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text"))
    model = Model(spark, docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()), scratch, head, frequent, groups, classes)
    shared = spark.sparkContext.broadcast(model.units)
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "codes", "rare", "guess"]

    def read(batches):
        """Classes of a text's words; the i-th distinct word that the worker lacks stands as classes + i."""
        from pyspark import TaskContext

        m, row = shared.value, TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text in batch.column("text"):
                    words = tokens(text.as_py())
                    found = m.find(words)
                    known = found >= 0
                    own, rare = Numbers(), int((~known).sum())
                    codes = np.empty(len(words), np.uint32)
                    codes[known] = m.of[found[known]]
                    codes[~known] = m.classes + np.fromiter(map(own.__getitem__, compress(words, ~known)), np.uint32, rare)
                    codes = codes.astype(np.uint16) if m.classes + len(own) < 1 << 16 else codes
                    rows.append((row, len(words) + 1, int(known.sum()), float(m.log[found[known]].sum()) + m.end_log, codes.tobytes(), list(own), [int(m.endings[ending(w, m.groups)]) for w in own]))
                    row += 1
                r, n, k, b, c, rare, guess = zip(*rows)
                columns = [pa.array(r, pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.float64()), pa.array(c, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(guess, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    first = scratch.save(docs.mapInArrow(read, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, codes binary, rare array<binary>, guess array<int>"))
    rare = first.select("row", F.posexplode("rare").alias("at", "word")).join(model.words.where(F.col("n") < model.least), "word")
    rare = rare.groupBy("row").agg(F.collect_list(F.struct("at", "n", "class")).alias("found"))
    denominator, total, count = model.denominator, model.total, len(model.mass)

    def fill(batches):
        for whole in batches:
            for batch in slices(whole, "codes"):
                known, base, out = [], [], []
                for n, k, b, codes, guess, found in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "n_known", "base", "codes", "guess", "found"))):
                    code = np.frombuffer(codes, np.uint16 if len(codes) == 2 * (n - 1) else np.uint32).astype(np.int64)
                    seen, of = np.zeros(len(guess)), np.array(guess, np.int64)
                    for x in found or ():
                        seen[x["at"]], of[x["at"]] = x["n"], x["class"]
                    times = np.bincount(code[code >= count] - count, minlength=len(guess))
                    out.append(np.concatenate([np.arange(count), of])[code].astype(np.uint8).tobytes())
                    known.append(k + int(times[seen > 0].sum()) + (total > 0))
                    base.append(b + float((times * np.log10((seen + SMOOTHING) / denominator)).sum()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens")), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(out, pa.binary())], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "classes"])

    filled = first.drop("rare").join(rare, "row", "left")
    texts = scratch.save(filled.select(*names[1:7], "guess", "found").mapInArrow(fill, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, classes binary"))
    scratch.drop(first)

    def steps(sequence: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Classes and the classes before them; the end is class 0 and stands before the first word."""
        c = np.concatenate([[0], np.frombuffer(sequence, np.uint8), [0]]).astype(np.int64)
        return c[:-1], c[1:]

    def pairs(batches):
        table = np.zeros(count * count, np.int64)
        for batch in batches:
            for sequence in batch.column(0):
                a, b = steps(sequence.as_py())
                table += np.bincount(a * count + b, minlength=count * count)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["pair", "n"])

    got = texts.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("classes").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(count * count)  # a row for each pair of classes
    table[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    given, p = transitions(table.reshape(count, count), model.mass)
    lift = np.log10(weight * given / p + 1 - weight)

    def rate(batches):
        for batch in batches:
            gain = [float(lift[steps(x.as_py())].sum()) for x in batch.column("classes")]
            columns = [*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array([total] * len(batch), pa.int64()), batch.column("base_score"), pa.array(np.array(batch.column("base_score").to_pylist(), float) + np.array(gain, float))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.mapInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
