"""Best-fit packing of tokenized documents into fixed-length sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. What has to be packed is described completely by the
histogram of piece lengths (at most ``capacity`` entries, whatever the corpus), so the plan is made on the driver:
for the longest length left, a bitset subset-sum search over the available lengths finds the fullest feasible
combination; it is removed as often as the counts allow. The plan is a list of runs "the pieces of this length with
ranks a..b go to these sequences at these offsets", applied to all pieces in parallel; ranks within a length come from
per-task counts, so no length, however common, is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colframe.llm.bpe import encoder
from colframe.llm.common import Scratch, ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths (longest first, each used at most counts[length] times) whose sum is the largest not above room.

    Bit s of a set says that the sum s can be made. Sets after each length are kept to walk back from the best sum.
    """
    mask = (1 << (room + 1)) - 1
    sets, used, reach = [1], [], 1
    for x in lengths:
        if x > room:
            continue
        left, step = min(counts[x], room // x), 1
        while left:  # counts as powers of two and a rest
            take = min(step, left)
            new = (reach | (reach << (take * x))) & mask
            if new != reach:
                sets.append(new)
                used.append((x, take))
                reach = new
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, []
    for i in range(len(used), 0, -1):
        x, take = used[i - 1]
        if not sets[i - 1] >> best & 1:
            out += [x] * take
            best -= x * take
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks per sequence, first sequence, sequences, offset) for a histogram of lengths."""
    counts = {x: c for x, c in histogram.items() if c > 0}
    rank: Counter = Counter()
    runs, sequence = [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        bin_ = Counter([top, *fullest(lengths, counts, capacity - top)])
        counts[top] += 1
        times = min(counts[x] // m for x, m in bin_.items())
        offset = 0
        for x in sorted(bin_, reverse=True):
            m = bin_[x]
            runs.append((x, rank[x], m, sequence, times, offset))
            rank[x] += m * times
            counts[x] -= m * times
            offset += m * x
        sequence += times
        lengths = [x for x in lengths if counts[x]]
    return runs


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, with its task and its rank among the task's pieces of that length."""

    def cut(batches):
        from pyspark import TaskContext

        enc, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, batch.column(1)):
                raw = enc.encode(text.as_py() or "") + end
                n = len(raw) // 4
                a, k = 0, 0
                while a < n:
                    b = min(n, a + (n % capacity or capacity if a == 0 else capacity))
                    size = b - a
                    for column, value in zip(rows, (doc, k, a, size, zlib.crc32(raw[4 * a : 4 * b]), task, seen[size])):
                        column.append(value)
                    seen[size] += 1
                    a, k = b, k + 1
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Packs documents(doc_id, text) into sequences of at most ``capacity`` tokens.

    Every row of docs is a document of its own: repeated rows are packed each. A null or empty text is the end token
    alone; a null doc_id is carried as null. An empty table gives no rows; other columns are ignored.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    ship(spark)
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, tokenizer, end_id, capacity))
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.save(by_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    histogram = {r.length: r.n for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs: dict[int, list] = {}
    for x, *run in plan(histogram, capacity):
        runs.setdefault(x, []).append(run)
    placed = {x: np.array(r, np.int64) for x, r in runs.items()}
    shared = spark.sparkContext.broadcast(placed)

    def place(batches):
        table = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                run = table[int(x)]
                r = run[np.searchsorted(run[:, 0], rank[at], "right") - 1]
                within = rank[at] - r[:, 0]
                sequence[at] = r[:, 2] + within // r[:, 1]
                offset[at] = r[:, 4] + within % r[:, 1] * x
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base.drop("n"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
