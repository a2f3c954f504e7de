"""Near-duplicate paragraphs and repeated passages: MinHash banding, exact verification, removal by components.

A paragraph is a line with enough words. Paragraphs with the same word shingles are one class; classes that collide in
a band of MinHash values are candidates, and those whose exact Jaccard similarity reaches the threshold are linked. In
each component the paragraph that comes first (by doc_id, then place) stays, the others are removed.

A passage is a run of words, inside a line or across lines, that stands at an earlier place too. Of each window of
word k-grams the one with the smallest hash is an anchor, so a passage that is long enough holds one, the same at each
of its places. An anchor, with words before or behind it, is matched with its first place in the corpus, and the run of
equal words around the two is followed to its ends on the texts. Every word that is removed stands at an earlier place, so one copy of it stays.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import SOLID, Scratch, lean, mix, shingle_hashes, ship, slices, word_hashes
from colframe.llm.linking import BOUND, buckets, linked

#: Contents that a task remembers so as not to sign them again; bytes of text that are worked on at once.
SEEN, TEXTS = 100_000, 1 << 19
#: Windows whose smallest hashes are looked for at once.
WINDOWS = 1 << 12


def tune(similarity: float, recall: float, rows: int = 4) -> int:
    """Bands of ``rows`` MinHash values with which a pair of that similarity collides with probability ``recall``."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


def laid_out(texts: list[bytes]):
    """Words of all texts: hash, number of the text, line (numbered across texts), start and end byte in the text."""
    data = b"\n".join(texts)
    h, start, end = word_hashes(data, SOLID)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    of = np.searchsorted(first, start, "right") - 1
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), start)
    return h, of, line, start - first[of], end - first[of]


def heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)


def paragraphs(h: np.ndarray, line: np.ndarray, k: int, least: int):
    """First word, end word, and shingle sets of lines of ``least`` words (and k): all hashes, and where each set begins."""
    first = heads(line)
    size = np.diff(np.append(first, len(h)))
    if len(h) < k:
        return first[:0], first[:0], h[:0], first[:0]
    of = np.repeat(np.arange(len(first)), size)
    g = shingle_hashes(h, k)
    inside = (of[: len(g)] == of[k - 1 :]) & (size >= least)[of[: len(g)]]
    of, g = of[: len(g)][inside], g[inside]
    order = np.lexsort((g, of))
    of, g = of[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (of[1:] != of[:-1]) | (g[1:] != g[:-1])
    of, g = of[new], g[new]
    begin = heads(of)
    lines = of[begin]
    return first[lines], first[lines] + size[lines], g, begin


def set_prints(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    if not len(begin):
        return begin, begin
    with np.errstate(over="ignore"):
        a, b = mix(h + np.uint64(1)), mix(h ^ np.uint64(0x5851F42D4C957F2D))
        return tuple(np.add.reduceat(x, begin).view(np.int64) for x in (a, b))


def set_sketches(h: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Parity bitmap of each set: an element flips one of 2**k > 4 * n bits (64 at least) for a set of n."""
    n = np.diff(np.append(begin, len(h)))
    of, power, out = np.repeat(np.arange(len(n)), n), np.maximum(6, np.frexp(4 * n)[1]), [b""] * len(n)
    for k in np.unique(power):
        at = np.flatnonzero(power == k)
        rank = np.zeros(len(n), np.int64)
        rank[at] = np.arange(len(at))
        some = (power == k)[of]
        bit = (rank[of[some]] << int(k)) + ((h[some] >> np.uint64(5)) & np.uint64((1 << int(k)) - 1)).astype(np.int64)
        maps = np.packbits((np.bincount(bit, minlength=len(at) << int(k)) & 1).astype(np.uint8).reshape(len(at), -1), axis=1)
        for i, m in zip(at, maps):
            out[i] = m.tobytes()
    return out


def band_signatures(h: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) signatures, each of ``rows`` MinHash values; no set is empty."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    out = np.tile(mix(np.arange(bands, dtype=np.uint64) + np.uint64(77)), (len(begin), 1))
    if not len(begin):
        return out
    with np.errstate(over="ignore"):
        for i in range(bands):
            for s in seeds[i * rows : (i + 1) * rows]:
                low = np.minimum.reduceat((h ^ s) * np.uint64(0x9E3779B97F4A7C15), begin)
                out[:, i] = mix(out[:, i] * np.uint64(31) + low)
    return out


def anchors(h: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and first words of the anchors of texts (of: a word's text), in the order of the words.

    Every run of ``least`` words holds an anchor, its k-gram with the smallest hash. Of the words beside the anchor the
    run has half of ``least`` - k before or behind it at least, so an anchor has two signatures, which are its k-gram
    with so many words before it and with so many behind it: two places of a run share one of them. Where the same
    k-gram repeats at once, as in a word said over and over, its first place is the anchor.
    """
    k = max(1, -(-least // 3))
    width, more = least - k + 1, (least - k + 1) // 2
    if len(h) < least:
        return h[:0], of[:0]
    g, wide = shingle_hashes(h, k), shingle_hashes(h, k + more)
    windows = np.lib.stride_tricks.sliding_window_view(g, width)
    at = np.arange(len(windows))
    for i in range(0, len(at), WINDOWS):  # argmin copies its windows
        at[i : i + WINDOWS] += windows[i : i + WINDOWS].argmin(1)
    at = np.unique(at[of[: len(at)] == of[least - 1 :]])
    again = np.zeros(len(g), bool)
    for d in (1, 2):
        again[d:] |= (g[d:] == g[:-d]) & (of[d : len(g)] == of[: len(g) - d])
    at = at[~again[at]]
    left = at[at >= more]
    left = left[of[left - more] == of[left]]
    right = at[at + k + more <= len(h)]
    right = right[of[right + k + more - 1] == of[right]]
    with np.errstate(over="ignore"):
        value = np.concatenate([mix(wide[left - more] + np.uint64(1)), mix(wide[right] + np.uint64(2))])
    place = np.concatenate([left, right])
    order = np.argsort(place, kind="stable")
    return value[order], place[order]


def runs(a: np.ndarray, b: np.ndarray, at: np.ndarray, first: np.ndarray, least: int, same: bool) -> list[tuple[int, int, int]]:
    """Runs of ``least`` equal words of a and b around matches (at, first): (start in a, start in b, words).

    same: both are one text; then a run must lie its ``least`` words or more behind its first place.
    """
    out = set()
    for d in np.unique(at - first).tolist():
        if same and d < least:
            continue
        left, right = max(d, 0), max(-d, 0)
        m = min(len(a) - left, len(b) - right)
        breaks = np.flatnonzero(a[left : left + m] != b[right : right + m])
        i = np.searchsorted(breaks, at[at - first == d] - left)
        low, high = np.append(-1, breaks)[i] + 1, np.append(breaks, m)[i]
        for x, y in set(zip(low.tolist(), high.tolist())):
            if y - x >= least:
                out.add((x + left, x + right, y - x))
    return sorted(out)


def around(h: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of all runs of ``least`` words that hold the anchors at ``at``."""
    low = np.maximum(at - (least - max(1, -(-least // 3))), 0)
    near = np.zeros(len(h) + 1, np.int64)
    np.add.at(near, low, 1)
    np.add.at(near, at + 1, -1)
    start = np.flatnonzero(np.cumsum(near)[: max(0, len(h) - least + 1)])
    return shingle_hashes(h, least)[start] if len(start) else h[:0], start


def matched(spark: SparkSession, scratch: Scratch, docs: DataFrame, hits: DataFrame, least: int) -> DataFrame:
    """Runs around hits(sig, doc_id, key, at) and the first hit of their signature: (doc_id, key, start, end, n_words,
    doc0, key0, start0, end0, at), where at is the run's first word and all other places are bytes."""
    first = scratch.save(hits.groupBy("sig").agg(F.min(F.struct("doc_id", "key", "at")).alias("x")).select("sig", F.col("x.doc_id").alias("doc0"), F.col("x.key").alias("key0"), F.col("x.at").alias("at0")))
    later = hits.join(first, "sig").where((F.col("doc_id") != F.col("doc0")) | (F.col("key") != F.col("key0")) | (F.col("at") - F.col("at0") >= least))
    pairs = scratch.save(later.groupBy("doc_id", "key", "doc0", "key0").agg(F.collect_set(F.struct("at", "at0")).alias("hits")))
    ends = pairs.select("doc_id", "key").union(pairs.select("doc0", "key0"))
    texts = scratch.save(texts_of(scratch, docs, ends))
    both = pairs.join(texts, ["doc_id", "key"]).join(texts.toDF("doc0", "key0", "text0"), ["doc0", "key0"])
    names = ["doc_id", "key", "start", "end", "n_words", "doc0", "key0", "start0", "end0", "at"]

    def follow(batches):
        for whole in batches:
            for batch in slices(whole, "text0"):
                out = []
                for doc, key, doc0, key0, text, text0, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "doc0", "key0", "text", "text0", "hits"))):
                    (a, sa, ea), (b, sb, eb) = word_hashes(text, SOLID), word_hashes(text0, SOLID)
                    at, at0 = (np.array([x[c] for x in found]) for c in ("at", "at0"))
                    for i, j, n in runs(a, b, at, at0, least, (doc, key) == (doc0, key0)):
                        out.append((doc, key, int(sa[i]), int(ea[i + n - 1]), n, doc0, key0, int(sb[j]), int(eb[j + n - 1]), i))
                columns = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return scratch.save(both.select("doc_id", "key", "doc0", "key0", "text", "text0", "hits").mapInArrow(lean(follow), ", ".join(f"{c} long" for c in names)))


def texts_of(scratch: Scratch, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of docs(doc_id, key, text) for each of keys(doc_id, key), which may repeat."""
    keys = scratch.save(keys.distinct())
    few = keys.count() <= BOUND
    return docs.join(F.broadcast(keys) if few else keys, ["doc_id", "key"], "left_semi").select("doc_id", "key", "text").dropDuplicates(["doc_id", "key"])


def passages(spark: SparkSession, scratch: Scratch, docs: DataFrame, marked: DataFrame, least: int) -> DataFrame:
    """(doc_id, key, start, end, n_words, doc0, key0, start0, end0): runs of words and an earlier place of each.

    marked(doc_id, key, node, sigs, at) has the anchors of each row of docs(doc_id, key, text). An anchor that no run
    with its first place covers may still lie in a run with another place: all windows of ``least`` words that hold
    it, or another place of its signature, are then matched by their own first places.
    """

    def places(marked: DataFrame) -> DataFrame:
        hits = scratch.save(buckets(spark, marked.select("node", "sigs", "at"), places=True))
        return scratch.save(hits.join(marked.select("doc_id", "key", "node"), "node").select("sig", "doc_id", "key", "at").distinct())

    hits = places(marked)
    found = matched(spark, scratch, docs, hits, least)
    spans = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", (F.col("at") + F.col("n_words")).alias("end"))).alias("spans"))
    k = max(1, -(-least // 3))
    first = hits.groupBy("sig").agg(F.min(F.struct("doc_id", "key", "at")).alias("first"))
    later = scratch.save(hits.join(scratch.save(first), "sig").where(F.struct("doc_id", "key", "at") != F.col("first")).select("sig", "doc_id", "key", "at"))
    alone = later.join(spans, ["doc_id", "key"], "left").where(F.col("spans").isNull() | ~F.exists("spans", lambda x: (x["at"] <= F.col("at")) & (F.col("at") + k <= x["end"])))
    several = later.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")  # else the first place is the only other one
    open_ = scratch.save(alone.select("sig").distinct().join(several, "sig", "left_semi"))
    again = scratch.save(hits.join(open_, "sig").groupBy("doc_id", "key").agg(F.collect_set("at").alias("places")))
    texts = texts_of(scratch, docs, again.select("doc_id", "key")).join(again, ["doc_id", "key"])

    def widen(batches):
        from pyspark import TaskContext

        node = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                sigs, at = [], []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                    value, start = around(word_hashes(text, SOLID)[0], np.array(found, np.int64), least)
                    sigs.append(value.tobytes())
                    at.append(start.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.arange(node, node + len(batch))), pa.array(sigs, pa.binary()), pa.array(at, pa.binary())], ["doc_id", "key", "node", "sigs", "at"])
                node += len(batch)

    wide = scratch.save(texts.mapInArrow(lean(widen), "doc_id long, key long, node long, sigs binary, at binary"))
    more = matched(spark, scratch, docs, places(wide), least)
    return scratch.save(found.union(more).drop("at").distinct())


def duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, share: tuple[int, int] = (4, 5), line: int = 20, least: int = 48, recall: float = 0.9995) -> DataFrame:
    """Paragraphs and passages of docs(doc_id, text) that stand at another place too, in the same or another document.

    Returns doc_id, text_key (xxhash64 of the text), start and end (bytes of the text in UTF-8), n_words,
    component_doc and component_start (the place that stays) and removed, one row for each such place; other columns
    of docs are not read. Lines of fewer than ``line`` words (and k) and passages of fewer than ``least`` take no
    part; a null or empty text has neither. Equal rows count once; texts that share a doc_id are told apart by their
    key. Rows with a null doc_id take no part. A passage that repeats inside its text counts from ``least`` words
    behind its first place on. Words are runs of non-space characters with A-Z lower-cased. Bands are tuned so that
    paragraphs at the threshold collide with probability ``recall``; what collides is verified exactly.
    """
    ship(spark)
    scratch = Scratch(spark, "paragraphs")
    docs = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    rows_ = 4
    bands_ = tune(share[0] / share[1], recall, rows_)
    names = ["doc_id", "key", "node", "start", "end", "n_words", "n", "f1", "f2", "sketch", "sigs"]
    schema = ", ".join(f"{c} {'long' if i < 9 else 'binary'}" for i, c in enumerate(names))

    def sign(batches):
        """A row for each paragraph; and one for each text, whose start is -1, with its anchors and their places."""
        from pyspark import TaskContext

        node, seen = TaskContext.get().partitionId() << 40, set()
        for whole in batches:
            for batch in slices(whole, "text", TEXTS):
                doc, key = (batch.column(c).to_numpy() for c in ("doc_id", "key"))
                h, of, lines, start, end = laid_out([t or b"" for t in batch.column("text").to_pylist()])
                a, b, g, begin = paragraphs(h, lines, k, line)
                f1, f2 = set_prints(g, begin)
                size = np.diff(np.append(begin, len(g)))
                new = np.zeros(len(a), bool)
                new[np.unique(f1, return_index=True)[1]] = True
                for i in np.flatnonzero(new).tolist():  # equal sets are one class, signed once; what is forgotten is signed again
                    f = int(f1[i])
                    new[i] = f not in seen
                    seen.add(f)
                if len(seen) > SEEN:
                    seen.clear()
                some = g[np.repeat(new, size)]
                at = np.cumsum(np.append(0, size[new]))[:-1]
                sketches, sigs = [None] * len(a), [None] * len(a)
                for i, s, x in zip(np.flatnonzero(new).tolist(), set_sketches(some, at), band_signatures(some, at, bands_, rows_)):
                    sketches[i], sigs[i] = s, x.tobytes()
                value, place = anchors(h, of, least)
                text_first, owner = np.searchsorted(of, np.arange(len(doc))), of[place]
                cut = np.searchsorted(owner, np.arange(len(doc) + 1))
                place = (place - text_first[owner]).astype(np.int32)
                anchored = np.flatnonzero(cut[1:] > cut[:-1])
                parts = list(zip(cut[anchored], cut[anchored + 1]))
                d, zero = of[a], np.zeros(len(anchored), np.int64)
                columns = [np.append(doc[d], doc[anchored]), np.append(key[d], key[anchored]), np.arange(node, node + len(a) + len(anchored)), np.append(start[a], zero - 1), np.append(end[b - 1], zero), np.append(b - a, zero), np.append(size, zero), np.append(f1, zero), np.append(f2, zero)]
                node += len(a) + len(anchored)
                binary = [sketches + [place[x:y].tobytes() for x, y in parts], sigs + [value[x:y].tobytes() for x, y in parts]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), *(pa.array(c, pa.binary()) for c in binary)], names)

    signed = scratch.save(docs.mapInArrow(lean(sign), schema))
    marked = signed.where("start < 0").select("doc_id", "key", "node", "sigs", F.col("sketch").alias("at"))
    parts = passages(spark, scratch, docs, marked, least)
    lines = signed.where("start >= 0")
    rows = scratch.save(lines.drop("sketch", "sigs"))

    def contents(batches):
        for whole in batches:
            for batch in slices(whole, "text", TEXTS):
                texts, spans = [], []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                    texts += [text[x["start"] : x["end"]] for x in found]
                h, of, *_ = laid_out(texts)
                _, _, g, begin = paragraphs(h, of, k, k)
                f1, f2 = set_prints(g, begin)
                sets_ = pa.ListArray.from_arrays(pa.array(np.append(begin, len(g)).astype(np.int32)), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(f1.astype(np.int64)), pa.array(f2.astype(np.int64)), sets_], ["f1", "f2", "set"])

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = scratch.save(some.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
        few = wanted.agg(F.count("*") + F.sum(F.size("spans"))).first()[0] or 0
        return docs.join(F.broadcast(wanted) if few <= BOUND else wanted, ["doc_id", "key"]).select("text", "spans").mapInArrow(lean(contents), "f1 long, f2 long, set array<long>")

    of = scratch.save(linked(spark, scratch, lines, rows, sets_of, share, signed).select("doc_id", "key", "start", "end", "n_words", "comp"))
    place = F.struct("doc_id", "key", "start")
    first = scratch.save(of.groupBy("comp").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("comp", "first"))
    found = of.join(first, "comp").select("doc_id", "key", "start", "end", "n_words", (place != F.col("first")).alias("removed"), "first.doc_id", "first.start")
    names = ["doc_id", "text_key", "start", "end", "n_words", "removed", "component_doc", "component_start"]
    found = found.toDF(*names)
    found = found.union(parts.select("doc_id", "key", "start", "end", "n_words", F.lit(True), "doc0", "start0"))
    found = found.union(parts.select("doc0", "key0", "start0", "end0", "n_words", F.lit(False), "doc0", "start0"))
    out = found.groupBy("doc_id", "text_key", "start", "end").agg(F.max("n_words").alias("n_words"), F.max(F.struct("removed", "component_doc", "component_start")).alias("x"))
    return out.select("doc_id", "text_key", "start", "end", "n_words", "x.component_doc", "x.component_start", "x.removed")


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the byte spans; lines of which nothing is left go, others lose only the spans."""
    raw, lines, at = text.encode(), [], 0
    keep = np.ones(len(raw), bool)
    for a, b in spans:
        keep[a:b] = False
    for line in raw.split(b"\n"):
        left = keep[at : at + len(line)]
        new = line if left.all() else np.frombuffer(line, np.uint8)[left].tobytes()
        if new.strip() or not line.strip():
            lines.append(new)
        at += len(line) + 1
    return b"\n".join(lines).decode()


def remove(spark: SparkSession, docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the paragraphs that ``found`` (from duplicates()) marks as removed, and n_chars anew.

    Documents without a cut stay as they are; a document of which no word is left goes. Equal rows lose the same
    places. Columns are those of docs.
    """
    ship(spark)
    cuts = Scratch(spark, "cuts").save(found.where("removed").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("cuts")))
    few = cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0
    cuts = F.broadcast(cuts) if few <= BOUND else cuts
    kept, schema = docs.columns, docs.schema

    def cut(batches):
        for whole in batches:
            rows = whole.column("row").flatten()
            whole = pa.RecordBatch.from_arrays([*rows, whole.column("cuts")], [*map(str, range(len(kept))), "cuts"])
            for batch in slices(whole, str(kept.index("text"))):
                columns = batch.columns[:-1]
                texts, cuts_ = columns[kept.index("text")].to_pylist(), batch.column("cuts").to_pylist()
                new = [cut_out(t, [(c["start"], c["end"]) for c in x]) if x and t else t for t, x in zip(texts, cuts_)]
                keep = pa.array([not x or bool(t and t.strip()) for t, x in zip(new, cuts_)], pa.bool_())
                columns[kept.index("text")] = pa.array(new, pa.string())
                if "n_chars" in kept:
                    old = columns[kept.index("n_chars")]
                    columns[kept.index("n_chars")] = pa.array([len(t) if x and t else n for n, t, x in zip(old.to_pylist(), new, cuts_)], old.type)
                yield pa.RecordBatch.from_arrays(columns, kept).filter(keep)

    cuts = cuts.select(F.struct("doc_id", "text_key").alias("at"), "cuts")
    rows = docs.select(F.struct(*kept).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("at"))
    return rows.join(cuts, "at", "left").select("row", "cuts").mapInArrow(lean(cut), schema)
