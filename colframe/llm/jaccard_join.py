"""Set similarity self-join on word n-grams by universe partitioning.

Sets are grouped in bands by size. For a band, two sets that are similar enough differ in at most H elements. The
universe of elements is hashed into segments: with m segments of threshold 0 (equal contents match) and threshold 1
(contents that differ in one element match), of which each side leaves out e of the first kind, m0 + 2 m1 - 2 e > H
makes every similar pair match in a segment that neither left out. Threshold 1 is met by signing the contents and
every one-deletion neighbourhood. How many segments of each kind there are, and which are left out, is chosen by
cost: signatures against the pairs that small or common contents are expected to bring. Candidates are verified on
their sets exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import SOLID, Scratch, lean, mix, shingle_hashes, ship, slices, word_hashes
from colframe.llm.linking import keyed_rows, linked, sketch

GROWTH = 1.6
#: Contents that a task remembers so as not to sign them again.
SEEN = 100_000


@dataclass(frozen=True)
class Band:
    """Sizes low..high; m0 segments of threshold 0, of which ``skip`` are left out by each set; m1 of threshold 1."""

    number: int
    low: int
    high: int
    m0: int
    m1: int
    skip: int


def differences(size: int, share: tuple[int, int]) -> int:
    """Most elements in which two sets can differ, if the smaller has at most ``size`` and share[1] * common >= share[0] * union."""
    p, q = share
    most = size + size * q // p
    return max(s - 2 * -(-p * s // (p + q)) for s in range(max(0, most - 4), most + 1))


def excess(mean: float, skip: int) -> float:
    """Expected number by which a Poisson variable exceeds ``skip`` (its deviation is neglected for large ones)."""
    if skip > 1000:
        return max(0.0, mean - skip)
    p, missed = math.exp(-mean), 0.0
    for k in range(skip + 1):
        missed += p * (skip - k)
        p *= mean / (k + 1)
    return max(0.0, mean - skip + missed)


def allocate(number: int, low: int, high: int, share: tuple[int, int], sets: float, rare: float = 1.0) -> Band:
    """The cheapest allocation for a band of about ``sets`` sets, of whose elements a share ``rare`` are in few others.

    A set of n elements has Poisson segments of mean n / (m0 + m1). Those without a rare element say little; the
    expected cost is a set's signatures plus the sets that it meets in such segments that it keeps, each weighing as
    much as a signature. Few segments are one-deletion segments, since each of their elements is a signature.
    """
    h = differences(high, share)
    best = None
    for part in (0, 0.02, 0.05):
        for extra in (0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3):
            skip = math.ceil(extra * (h + 1)) if extra else 0
            need = h + 1 + 2 * skip
            m1 = math.floor(part * need / 2)
            m0 = need - 2 * m1
            if skip > m0:
                continue
            mean = math.sqrt(low * high) / (m0 + m1)
            empty = math.exp(-mean * rare)
            kept = excess(m0 * empty, skip) + m1 * empty * (1 + mean)
            cost = m0 - skip + m1 * (1 + mean) + sets * kept * empty
            if best is None or cost < best[0]:
                best = (cost, Band(number, low, high, m0, m1, skip))
    return best[1]


def bands(share: tuple[int, int], largest: int, sizes: np.ndarray, total: int, rare: float = 1.0) -> list[Band]:
    """Allocations for all sizes up to ``largest``; ``sizes`` are those of a sample of the ``total`` sets."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * GROWTH))
        own = ((sizes >= low) & (sizes <= high)).mean() * total if len(sizes) else total
        out.append(allocate(len(out), low, high, share, own, rare))
        low = high + 1
    return out


def signatures(h: np.ndarray, plan: list[Band], share: tuple[int, int], common: np.ndarray) -> np.ndarray:
    """Signatures of a set of hashes (distinct): in its own band, and in the one below if a similar set may be there.

    common: sorted hashes of elements that many sets have; segments with few other elements are left out first.
    """
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    k = next(b.number for b in plan if n <= b.high)
    rare = np.ones(n, bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h
    out = []
    for b in plan[max(0, k - 1) : k + 1]:
        if b.number < k and -(-share[0] * n // share[1]) > b.high:
            continue
        m = b.m0 + b.m1
        with np.errstate(over="ignore"):
            x = mix(h ^ np.uint64(0xA24BAED4963EE407 + b.number))
            part = (x % np.uint64(m)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            value = mix(x)[order]
            size = np.bincount(part, minlength=m)
            end = np.cumsum(size)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            content = sums[end] - sums[end - size]
            tag = mix(np.arange(m, dtype=np.uint64) + np.uint64((b.number + 1) << 32))
            if b.m1:
                inside = end[b.m1 - 1]
                seg = part[order[:inside]]
                out.append(mix(content[: b.m1] + tag[: b.m1]))
                out.append(mix(content[seg] - value[:inside] + tag[seg]))
            rest = np.arange(b.m1, m)
            if b.skip:
                few = np.bincount(part, rare, m)[rest]
                rest = rest[np.lexsort((size[rest], few))[b.skip :]]
            out.append(mix(content[rest] + tag[rest]))
    return np.concatenate(out)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Distinct hashes of a text's runs of k words (of all its words, if fewer), ascending."""
    return np.unique(shingle_hashes(word_hashes(text, SOLID)[0], k)) if text else np.empty(0, np.uint64)


def prints(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    with np.errstate(over="ignore"):
        a, b = mix(h + np.uint64(1)).sum(dtype=np.uint64), mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def join(spark: SparkSession, docs: DataFrame, k: int = 5, share: tuple[int, int] = (4, 5), sample: int = 2000) -> DataFrame:
    """Links documents of docs(doc_id, text) whose word k-gram sets have share[1] * common >= share[0] * union.

    Returns, for each row of docs, doc_id, n_shingles (size of its set) and component_id (smallest doc_id reachable by
    links). Words are runs of non-space characters with A-Z lower-cased; fewer than k words are one gram; a null,
    empty or blank text has no grams and no links. Rows with one doc_id are one document with several texts. A row
    with a null doc_id gets a null component_id and links nothing. Classes of equal sets are compared once, through
    one member. About ``sample`` rows (by a hash of the text) are read first for the sizes and common elements that
    the cost model uses; they don't change what is found.
    """
    ship(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    total = docs.count()

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shingles(t.as_py(), k).tobytes() for t in batch.column(0)], pa.binary())], ["h"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit("jaccard")), F.lit(1 << 20)) < min(1.0, sample / max(1, total)) * (1 << 20))
    seen = [np.frombuffer(r.h, np.uint64) for r in some.limit(4 * sample).mapInArrow(sets, "h binary").collect()]
    sizes = np.array([len(h) for h in seen])
    value, times = np.unique(np.concatenate([np.empty(0, np.uint64), *seen]), return_counts=True)
    common = value[times >= 3]
    rare = float(np.median([1 - np.isin(h, common).mean() for h in seen if len(h)] or [1.0]))
    shared = spark.sparkContext.broadcast((bands(share, 1 << 26, sizes, total, max(rare, 0.5)), common))

    def sign(batches):
        from pyspark import TaskContext

        plan, common = shared.value
        node, seen = TaskContext.get().partitionId() << 40, set()
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                    h = shingles(text.as_py(), k)
                    f = prints(h)
                    if not doc.is_valid or f in seen:  # equal sets are one class, which needs its signatures once; what is forgotten is sent again
                        rows.append((node, len(h), *f, None, None))
                    else:
                        rows.append((node, len(h), *f, sketch(h), signatures(h, plan, share, common).tobytes()))
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(f)
                    node += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "node", "n", "f1", "f2", "sketch", "sigs"])

    signed = scratch.save(docs.mapInArrow(lean(sign), "doc_id long, node long, n long, f1 long, f2 long, sketch binary, sigs binary"))
    rows = scratch.save(signed.select("doc_id", "node", "n", "f1", "f2"))
    real = "n > 0 and doc_id is not null"

    def contents(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [shingles(t.as_py(), k) for t in batch.column("text")]
                f = [prints(h) for h in found]
                sets_ = pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.int64()), pa.array([x[1] for x in f], pa.int64()), sets_], ["f1", "f2", "set"])

    def sets_of(some: DataFrame) -> DataFrame:
        return keyed_rows(docs, some.select("doc_id").distinct(), "doc_id").mapInArrow(lean(contents), "f1 long, f2 long, set array<long>")

    def given(classes: DataFrame) -> DataFrame:
        """Texts of one doc_id are linked."""
        several = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
        return classes.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a < b").distinct()

    of = linked(spark, scratch, signed.where(real), rows.where(real), sets_of, share, signed, given)
    of = scratch.save(of.select("doc_id", "node", "comp"))
    least = scratch.save(of.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    out = rows.select("doc_id", "node", "n").join(of.select("node", "comp"), "node", "left").join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
