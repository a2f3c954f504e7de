"""Exact components of a similarity graph from candidate buckets, without emitting all pairs of a bucket.

Candidates share a bucket. In star rounds every component of a bucket offers one member to the bucket's hub, and each
component verifies the most promising of its offers only. What is still apart then is compared in place, across
components, by bitmaps that rule out no link; a component verifies its most promising pairs first, more of them in
each round, and rounds end when none was left out. After every round components are contracted, so verified pairs stay
linear in members although each pair of a bucket is verified, ruled out or already in one component.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import Scratch, elements, lean, slices

#: Rows of 8-byte keys that may be broadcast.
BOUND = 1_000_000
#: Members of a bucket that a task compares with as many others, bytes of signatures in a range and between two merges.
CHUNK, RANGE, MERGE = 2048, 4 << 20, 8 << 20
#: Star rounds at most, pairs that a component verifies in the first round across and how that number grows.
STARS, FIRST, MORE = 4, 4, 8
#: Rows of a group up to which pairs are compared one by one; rows of small buckets that share a sketch of each node.
FEW, LOAD = 24, 4 * CHUNK


def buckets(spark: SparkSession, signed: DataFrame, places: bool = False) -> DataFrame:
    """(sig, node) of all signatures that two nodes or more have, from signed(node, sigs: binary of uint64).

    With places, signed has besides a binary ``at`` of an int32 for each signature, and rows are (sig, node, at) of
    signatures that two places or more have. Tasks send signatures in blocks by range, which are the rows that are
    shuffled. A range is merged block by block into one row for each distinct signature, so memory follows a range's
    distinct signatures, whatever number of nodes has one; the number of ranges follows the bytes of signatures.
    """
    total = signed.agg(F.sum(F.octet_length("sigs").cast("double"))).first()[0] or 0.0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 8, int(total / RANGE) + 1)
    names = ["sig", "node", *(["at"] if places else [])]

    def send(batches):
        for whole in batches:
            for batch in slices(whole, "sigs", RANGE):
                sig, counts = elements(batch.column("sigs"), np.uint64)
                if not len(sig):
                    continue
                node = np.repeat(batch.column("node").to_numpy(), counts)
                part = (sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                sig, node, part = sig[order], node[order], part[order]
                at = elements(batch.column("at"), np.int32)[0][order] if places else np.empty(0, np.int32)
                used, start = np.unique(part, return_index=True)
                cuts = list(zip(start, [*start[1:], len(part)]))
                base = [int(node[s:e].min()) for s, e in cuts]
                # a batch may hold rows of several tasks, whose nodes are far apart: offsets of 4 bytes only if they fit
                near = [node[s:e] - b for (s, e), b in zip(cuts, base)]
                near = [(x.astype(np.uint32) if x.max() < 1 << 32 else x).tobytes() for x in near]
                columns = [pa.array(used.astype(np.int64)), pa.array([sig[s:e].tobytes() for s, e in cuts], pa.binary()), pa.array(near, pa.binary()), pa.array(base, pa.int64()), pa.array([at[s:e].tobytes() for s, e in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "sigs", "nodes", "base", "at"])

    def rows_of(*columns):
        for a in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in (columns[0].view(np.int64), *columns[1 : len(names)])], names)

    def merge(state, blocks):
        """The new state, and rows to send: a signature's first row waits in the state until there is another."""
        sig, node, at, sent = (np.concatenate(x) for x in zip(state, *blocks))
        order = np.lexsort((at, node, sig))
        sig, node, at, sent = sig[order], node[order], at[order], sent[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]) | (at[1:] != at[:-1])
        first = np.flatnonzero(new)
        sent = np.maximum.reduceat(sent, first) if len(first) else sent
        sig, node, at = sig[first], node[first], at[first]
        head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, np.int64)
        size = np.diff(np.append(head, len(sig)))
        go = (np.repeat(size, size) > 1) & ~sent
        was = np.logical_or.reduceat(sent, head) if len(head) else sent
        return (sig[head], node[head], at[head], was | (size > 1)), (sig[go], node[go], at[go])

    def group(batches):
        none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool))
        now, state, blocks, size = None, none, [], 0
        for batch in batches:
            for part, s, n, base, at in zip(*(batch.column(c).to_pylist() for c in ("part", "sigs", "nodes", "base", "at"))):
                if blocks and (part != now or size > MERGE):
                    state, out = merge(state, blocks)
                    blocks, size = [], 0
                    yield from rows_of(*out)
                if part != now:
                    now, state = part, none
                sig = np.frombuffer(s, np.uint64)
                node = np.frombuffer(n, np.int64 if len(n) == len(s) else np.uint32).astype(np.int64) + base
                blocks.append((sig, node, np.frombuffer(at, np.int32) if places else np.zeros(len(sig), np.int32), np.zeros(len(sig), bool)))
                size += len(s)
        if blocks:
            yield from rows_of(*merge(state, blocks)[1])

    blocks = signed.select("node", "sigs", *(["at"] if places else [])).mapInArrow(lean(send), "part long, sigs binary, nodes binary, base long, at binary")
    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(lean(group), "sig long, node long" + (", at int" if places else ""))


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of ``size`` bytes or a multiple of it as rows of ``size`` bytes, as uint64."""
    out = np.stack([np.frombuffer(x, np.uint64) for x in maps])
    while out.shape[1] * 8 > size:
        out = out[:, : out.shape[1] // 2] ^ out[:, out.shape[1] // 2 :]
    return out


def closest_few(side: list, node: list, comp: list, n: list, maps: list[bytes], share: tuple[int, int], most: int):
    """closest() for a few rows, without arrays."""
    p, q = share
    bits: dict[tuple[int, int], int] = {}

    def bitmap(i: int, size: int) -> int:
        if (i, size) not in bits:
            x, width = int.from_bytes(maps[i], "little"), len(maps[i])
            while width > size:
                width //= 2
                x = (x >> 8 * width) ^ (x & ((1 << 8 * width) - 1))
            bits[i, size] = x
        return bits[i, size]

    split, found = min(side) != max(side), []
    for i in range(len(node)):
        for j in range(i):
            total = n[i] + n[j]
            if comp[i] == comp[j] or split and side[i] == side[j] or q * min(n[i], n[j]) < p * max(n[i], n[j]):
                continue
            size = min(len(maps[i]), len(maps[j]))
            differ = (bitmap(i, size) ^ bitmap(j, size)).bit_count()
            if differ <= total - 2 * -(-p * total // (p + q)):
                found.append((differ / total, i, j))
    got, a, b, left = {}, [], [], False
    for _, i, j in sorted(found):
        x, y = got.get(comp[i], 0), got.get(comp[j], 0)
        if min(x, y) >= most:
            left = True
            continue
        got[comp[i]], got[comp[j]] = x + 1, y + 1
        a.append(min(node[i], node[j]))
        b.append(max(node[i], node[j]))
    return a, b, [left] * len(a)


def closest(side: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, maps: list[bytes], share: tuple[int, int], most: int):
    """Pairs of different components that sizes and bitmaps allow: (a, b, whether its component has more).

    Between the rows of side 0 and those of side 1; if there is but one side, between all of its rows, where the
    largest component needs no row of its own to look for partners. Each component gets its ``most`` closest pairs.
    """
    p, q = share
    if len(node) <= FEW:
        return closest_few(side.tolist(), node.tolist(), comp.tolist(), n.tolist(), maps, share, most)
    if side.min() == side.max():
        names, of = np.unique(comp, return_inverse=True)
        mine, theirs = np.flatnonzero(of != np.bincount(of).argmax()), np.arange(len(node))
    else:
        mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    length = np.array([len(x) for x in maps])
    found, many = [], np.zeros(len(node), np.int64)
    for s in np.unique(length[mine]):
        own = mine[length[mine] == s]
        for t in (s // 2, s, 2 * s):
            other = theirs[length[theirs] == t]
            if not len(other):
                continue
            y = folded([maps[j] for j in other], min(s, t))
            step = max(1, (1 << 21) // max(1, y.size))
            for a in range(0, len(own), step):
                i = own[a : a + step]
                x = folded([maps[j] for j in i], min(s, t))
                differ = np.zeros((len(i), len(other)), np.int64)
                for w in range(x.shape[1]):
                    differ += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
                total = n[i][:, None] + n[other]
                fit = (differ <= total - 2 * -(-p * total // (p + q))) & (comp[i][:, None] != comp[other]) & (q * np.minimum(n[i][:, None], n[other]) >= p * np.maximum(n[i][:, None], n[other]))
                many[i] += fit.sum(1)
                cost = np.where(fit, differ / total, np.inf)
                if len(other) > most:
                    at = np.argpartition(cost, most - 1, axis=1)[:, :most]
                    row, col = np.repeat(np.arange(len(i)), most), at.ravel()
                else:
                    row, col = (x.ravel() for x in np.indices(cost.shape))
                ok = np.isfinite(cost[row, col])
                row, col = row[ok], col[ok]
                found.append((i[row], other[col], cost[row, col]))
    if not found:
        return [], [], []
    i, j, cost = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((cost, comp[i]))
    i, j = i[order], j[order]
    head = np.flatnonzero(np.append(True, comp[i][1:] != comp[i][:-1])) if len(i) else np.empty(0, np.int64)
    size = np.diff(np.append(head, len(i)))
    rank = np.arange(len(i)) - np.repeat(head, size)
    more = np.repeat((np.maximum.reduceat(many[i], head) > most) | (size > most) if len(head) else size > 0, size)
    keep = rank < most
    i, j, more = i[keep], j[keep], more[keep]
    return np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), more


def across(scratch: Scratch, rows: DataFrame, sizes: DataFrame, open_: DataFrame, sketches: DataFrame, share: tuple[int, int], most: int) -> DataFrame:
    """Pairs (a, b, sig) of a bucket's rows(sig, node, comp) in different components that sizes and sketches allow.

    Buckets that have more such pairs have a row of their own, with a sig and no pair; pairs may repeat.

    Buckets of more than two chunks of members are split: a component that fills a chunk has chunks of its own, which
    need no comparison with each other, smaller ones share chunks, and every pair of chunks is a group of its own. So
    a group has two chunks of rows, and what a task compares and emits is bounded.

    Buckets with the same first node (by hash) have most of their nodes in common. They go to one task under one key,
    at most about LOAD rows of them, and each node's sketch is sent once a key, not once a bucket.
    """
    own = open_.where(F.col("m") <= 2 * CHUNK).select("sig", "low", "m")
    loads = own.groupBy("low").agg(F.ceil(F.sum("m") / LOAD).alias("of"))
    own = own.join(loads, "low").select("sig", F.xxhash64("low", F.pmod(F.xxhash64("sig"), "of")).alias("key"))
    small = rows.join(own, "sig").select("key", "sig", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("side"), "node", "comp")
    parts = small
    if open_.where(F.col("m") > 2 * CHUNK).limit(1).count():
        large = open_.where(F.col("m") > 2 * CHUNK).select("sig")
        mine = sizes.join(large, "sig").select("sig", "comp", "n")
        chunks = mine.select("sig", F.when(F.col("n") > CHUNK, F.col("comp")).otherwise(-1).alias("c"), "n").groupBy("sig", "c").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("k"))
        of = mine.select("sig", "comp", F.when(F.col("n") > CHUNK, F.col("comp")).otherwise(-1).alias("c")).join(chunks, ["sig", "c"])
        each = chunks.select("sig", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
        x, y = (each.select("sig", F.struct("c", "j").alias(s)) for s in "xy")
        plan = x.join(y, "sig").where((F.col("x") <= F.col("y")) & ((F.col("x.c") != F.col("y.c")) | (F.col("x.c") == -1)))
        plan = plan.select("sig", "x", "y", F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b"))
        dealt = rows.join(of, ["sig", "comp"]).select("sig", "node", "comp", F.struct("c", F.when(F.col("c") == -1, F.pmod(F.xxhash64("comp"), "k")).otherwise(F.pmod(F.xxhash64("node"), "k")).cast("int").alias("j")).alias("z"))
        key = F.xxhash64("sig", "a", "b").alias("key")
        left = dealt.join(plan.withColumnRenamed("x", "z"), ["sig", "z"]).select(key, "sig", "a", "b", F.lit(0).alias("side"), "node", "comp")
        right = dealt.join(plan.where("x != y").withColumnRenamed("y", "z"), ["sig", "z"]).select(key, "sig", "a", "b", F.lit(1).alias("side"), "node", "comp")
        parts = small.union(left).union(right)
    names = ["key", "sig", "a", "b", "side", "node", "comp", "n", "sketch"]
    parts = scratch.save(parts)
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("sig", "long"), ("a", "long"), ("b", "long"), ("side", "int"), ("comp", "long"), ("n", "long"), ("sketch", "binary"))}
    maps = parts.select("key", "node").distinct().join(sketches, "node").select("key", *(none[c] for c in ("sig", "a", "b", "side")), "node", none["comp"], "n", "sketch")
    both = parts.select(*names[:-2], none["n"], none["sketch"]).union(maps)
    sorted_ = both.repartition("key").sortWithinPartitions("key", "sig", "a", "b")  # a null sig, which has a sketch, comes first

    def send(found):
        """Each pair once, and a row for each bucket that has more."""
        ends = np.unique(np.array([np.concatenate([np.asarray(x[i], np.int64) for x in found]) for i in (1, 2)]), axis=1)
        sigs = sorted({x[0] for x in found if np.any(x[3])})
        columns = [pa.array(x).cast(pa.int64()) for x in ([*ends[0].tolist(), *[None] * len(sigs)], [*ends[1].tolist(), *[None] * len(sigs)], [*[None] * ends.shape[1], *sigs])]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "sig"])

    def pairs(group):
        if len(group) < 2:
            return [], [], []
        side, node, comp, n, maps = zip(*group)
        return closest(*(np.array(x, np.int64) for x in (side, node, comp, n)), maps, share, most)

    def run(batches):
        at, group, found, size, now, known = None, [], [], 0, None, {}

        def close():
            nonlocal size
            got = pairs(group)
            if len(got[0]):
                found.append((at[0], *got))
                size += len(got[0])

        for batch in batches:
            for key, sig, a, b, side, node, comp, n, bits in zip(*(batch.column(c).to_pylist() for c in names)):
                if sig is None:
                    if key != now:
                        close()
                        at, group, now, known = None, [], key, {}
                    known[node] = (n, bits)
                    continue
                if (sig, a, b) != at:
                    close()
                    at, group = (sig, a, b), []
                    if size > 300_000:
                        yield send(found)
                        found, size = [], 0
                group.append((side, node, comp, *known[node]))
        close()
        if found:
            yield send(found)

    return sorted_.mapInArrow(lean(run), "a long, b long, sig long")


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges (a, b), and the smallest node of each one's component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            return names, names[root]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]


def connected(spark: SparkSession, scratch: Scratch, edges: DataFrame, few: bool) -> DataFrame:
    """(node, comp) of all nodes of edges(a, b); comp is the component's smallest node.

    A number of edges that was found small (few) is one task's work. Else labels take the smallest label beside them
    and then their label's label, until none changes.
    """
    if few:

        def solve(batches):
            ends = [[x.column(c).to_numpy() for c in "ab"] for x in batches]
            if ends:
                columns = roots(*(np.concatenate(x) for x in zip(*ends)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "comp"])

        return edges.coalesce(1).mapInArrow(lean(solve), "node long, comp long")
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct())
    labels = scratch.save(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("up"), F.col("comp").alias("old"))
        step = scratch.save(step)
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("over"))
        new = scratch.save(step.join(jump, "up").select("node", F.col("over").alias("comp"), (F.col("over") != F.col("old")).alias("changed")))
        scratch.drop(step, labels)
        labels = new
        if not new.where("changed").limit(1).count():
            scratch.drop(both)
            return new.select("node", "comp")


def merged(spark: SparkSession, scratch: Scratch, labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels(node, comp) after links found(a, b) have joined components; only components are walked, not nodes."""
    ends = found.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
    edges = scratch.save(ends.where("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    n = edges.count()
    if not n:
        return labels
    few = 2 * n <= BOUND
    up = scratch.save(connected(spark, scratch, edges, few).toDF("comp", "up"))
    up = F.broadcast(up) if few else up
    return scratch.save(labels.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))


def link(spark: SparkSession, scratch: Scratch, members: DataFrame, verify: Callable[[DataFrame], DataFrame], given: DataFrame | None, sketches: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(node, comp) of all nodes of buckets members(sig, node), a saved table, and of given(a, b), links known before.

    verify gets distinct pairs (a, b), a < b, that sketches(node, n, sketch) don't rule out, and returns the links.
    """
    nodes = members.select("node")
    if given is not None:
        nodes = nodes.union(given.select("a")).union(given.select("b"))
    labels = scratch.save(nodes.distinct().select("node", F.col("node").alias("comp")))
    if given is not None:
        labels = merged(spark, scratch, labels, given)
    tried, stars, most, before = None, 0, FIRST, float("inf")
    while True:
        rows = members.join(labels, "node").select("sig", "node", "comp")
        sizes = rows.groupBy("sig", "comp").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(stars), "node").alias("h"), "node")).alias("low"))
        sizes = scratch.save(sizes.select("sig", "comp", "n", "low.h", "low.node"))
        open_ = sizes.groupBy("sig").agg(F.count("*").alias("comps"), F.sum("n").alias("m"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.min(F.struct(-F.col("n"), "h", "node", "comp")).alias("hub"), F.min("h").alias("low"))
        open_ = scratch.save(open_.where("comps > 1").select("sig", "m", "low", (F.col("m").cast("double") * F.col("m") - F.col("squares")).alias("cross"), "hub.node", "hub.comp"))
        cross, n_rows = open_.agg(F.sum("cross"), F.sum("m")).first()
        if not cross:
            return labels
        old, members = members, scratch.save(rows.join(open_.select("sig"), "sig", "left_semi").select("sig", "node"))
        scratch.drop(old)
        star = stars < STARS and 2 * n_rows < cross < 0.7 * before
        stars, before = stars + 1, cross
        if star:
            offer = sizes.select("sig", "comp", "node").join(open_.select("sig", F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "sig").where("comp != hub_comp")
            offer = scratch.save(offer.select("comp", "node", "hub").distinct())
            pairs = plausible(offer, sketches, share).groupBy("comp").agg(F.min(F.struct("cost", "node", "hub")).alias("x"))
            pairs = pairs.select(F.least("x.node", "x.hub").alias("a"), F.greatest("x.node", "x.hub").alias("b"))
        else:
            stars = STARS
            got = scratch.save(across(scratch, members.join(labels, "node").select("sig", "node", "comp"), sizes, open_, sketches, share, most))
            most *= MORE
            members = scratch.save(members.join(got.select("sig").where("sig is not null").distinct(), "sig", "left_semi"))
            pairs = got.select("a", "b").where("a is not null")
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs)
        found = verify(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        labels = merged(spark, scratch, labels, found)
        scratch.drop(sizes, open_)


def once(scratch: Scratch, members: DataFrame) -> DataFrame:
    """members(sig, node), a saved table, without buckets of one node; buckets with the same nodes (told by their
    number and two hashes) are one bucket. Its rows are distinct. The table is dropped."""
    sizes = members.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    kept = scratch.save(sizes.where("n > 1").groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig"))
    out = scratch.save(members.join(kept, "sig"))
    scratch.drop(members, kept)
    return out


def signers(scratch: Scratch, signed: DataFrame, reps: DataFrame) -> DataFrame:
    """signed(node, f1, f2, ...) without the rows of nodes that are not their content's reps(f1, f2, rep).

    Copies that several tasks have signed would share all their buckets. They are told by their nodes alone, so
    signatures are not shuffled unless the copies are many.
    """
    spare = scratch.save(signed.select("node", "f1", "f2").join(reps, ["f1", "f2"]).where("node != rep").select("node"))
    few = spare.count() <= BOUND
    return signed.join(F.broadcast(spare) if few else spare, "node", "left_anti")


def linked(spark: SparkSession, scratch: Scratch, signed: DataFrame, rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], share: tuple[int, int], spent: DataFrame, given: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows(node, f1, f2, ...) with copies (rows of the same set) and comp (the node that names the component).

    signed(node, n, f1, f2, sketch, sigs) has a signed row for the first node of each content (f1, f2); sigs of other
    rows may be null.
    sets_of gets some of rows and returns (f1, f2, set array<long>) of at least their contents. given, if any, gets
    rows with ``rep``, the node that stands for all rows of its content, and returns links (a, b) of such nodes.
    spent, the saved table behind signed, is dropped as soon as it has been read.
    """
    reps = scratch.save(rows.groupBy("f1", "f2").agg(F.min("node").alias("rep"), F.count("*").alias("copies")))
    classes = scratch.save(rows.join(reps, ["f1", "f2"]))
    members = once(scratch, scratch.save(buckets(spark, signers(scratch, signed.where("sigs is not null"), reps))))
    known = classes.where("node = rep").join(members.select(F.col("node").alias("rep")).distinct(), "rep", "left_semi").select("f1", "f2", "rep")
    sketches = signed.where("sketch is not null").join(known, ["f1", "f2"]).groupBy(F.col("rep").alias("node")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sketches = scratch.save(sketches)
    scratch.drop(spent)

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        some = scratch.save(keyed_rows(classes, ends, "node"))
        sets = sets_of(some).join(some.select("node", "f1", "f2"), ["f1", "f2"]).select("node", "set").dropDuplicates(["node"])
        sets = scratch.save(sets)
        out = scratch.save(overlapping(pairs, sets, share))
        scratch.drop(some, sets)
        return out

    labels = link(spark, scratch, members, verify, scratch.save(given(classes)) if given else None, sketches, share)
    return classes.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").select(*rows.columns, "copies", F.coalesce("comp", "rep").alias("comp"))


def sketch(h: np.ndarray) -> bytes:
    """Parity bitmap of a set of hashes: each flips one of 2**k > 4 * len(h) bits (64 at least).

    With bits to spare few elements cancel out, so hardly any pair passes that is not a link.
    """
    bits = 1 << max(6, int(4 * len(h)).bit_length())
    parity = np.bincount((h >> np.uint64(5)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def plausible(pairs: DataFrame, sketches: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (comp, node, hub) that sizes and sketches(node, n, sketch) don't rule out, with a cost (low: more alike).

    Sets that differ in d elements have bitmaps that differ in d bits at most, so more bits than a link's sets may
    differ by rule the pair out; no link is lost.
    """
    p, q = share
    hub = sketches.toDF("hub", "nb", "sb")
    both = pairs.join(sketches.toDF("node", "na", "sa"), "node").join(hub, "hub").where(q * F.least("na", "nb") >= p * F.greatest("na", "nb"))

    def check(batches):
        for batch in batches:
            keep, cost = [], []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                differ = int.from_bytes((x ^ y).tobytes(), "big").bit_count()
                keep.append(differ <= na + nb - 2 * -(-p * (na + nb) // (p + q)))
                cost.append(differ / (na + nb))
            columns = [batch.column("comp"), batch.column("node"), batch.column("hub"), pa.array(cost, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["comp", "node", "hub", "cost"]).filter(pa.array(keep, pa.bool_()))

    return both.select("comp", "node", "hub", "na", "nb", "sa", "sb").mapInArrow(lean(check), "comp long, node long, hub long, cost double")


def overlapping(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sets have share[1] * intersection >= share[0] * union; sets(node, set array<long>)."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(share[1] * common >= share[0] * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def keyed_rows(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is among the (distinct) keys; keys are broadcast only if they are few."""
    few = keys.count() <= BOUND
    return df.join(F.broadcast(keys) if few else keys, column, "left_semi")
