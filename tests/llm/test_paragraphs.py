import random

import numpy as np
from pyspark.sql import functions as F

from colframe.llm import jaccard_join, linking, paragraphs
from colframe.llm.common import SOLID, word_hashes


def make(rng, n):
    return " ".join(rng.choice("bcdfgh") + rng.choice("aeiou") + str(rng.randint(0, 400)) for _ in range(n))


def test_long_runs_hold_the_same_anchors():
    rng = random.Random(1)
    for n in (40, 41, 60):
        passage, seen = make(rng, n), []
        for _ in range(20):
            texts = [make(rng, rng.randint(0, 40)).encode(), (make(rng, rng.randint(0, 40)) + " " + passage + " " + make(rng, rng.randint(0, 40))).encode(), b""]
            h, of, line, start, end = paragraphs.laid_out(texts)
            assert [texts[i][a:b] for i, a, b in zip(of, start, end)] == b" ".join(texts).split() and len(set(line)) == len([t for t in texts if t])
            seen.append(set(paragraphs.anchors(h, of, 40)[0].tolist()))
        assert set.intersection(*seen)
    h, of, *_ = paragraphs.laid_out([b"x " * 500, b"x " * 500, b"a b " * 300])
    value, at = paragraphs.anchors(h, of, 40)
    assert sorted(set(at.tolist()))[:2] == [0, 500] and len(at) <= 8 and at.tolist() == sorted(at.tolist()) and len(paragraphs.anchors(h[:39], of[:39], 40)[0]) == 0


def test_kernels_against_sets():
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))).encode() for _ in range(50)]
    h, of, line, start, end = paragraphs.laid_out(texts)
    a, b, g, begin = paragraphs.paragraphs(h, line, 3, 6)
    want = [set(zip(w, w[1:], w[2:])) for t in texts for w in [x.split() for x in t.split(b"\n")] if len(w) >= 6]
    size = np.diff(np.append(begin, len(g)))
    assert size.tolist() == [len(x) for x in want] and len(a) == len(want)
    f1, f2 = paragraphs.set_prints(g, begin)
    maps = paragraphs.set_sketches(g, begin)
    for i, (s, n) in enumerate(zip(begin, size)):
        own = g[s : s + n]
        assert (int(f1[i]), int(f2[i])) == jaccard_join.prints(own) and maps[i] == linking.sketch(own)
    for i in range(0, len(want), 5):
        for j in range(len(want)):
            assert ((f1[i], f2[i]) == (f1[j], f2[j])) == (want[i] == want[j])


def test_duplicates_and_removal(spark):
    rng = random.Random(2)
    passage, line = make(rng, 70), make(rng, 60)
    words = line.split()
    words[30] = "changed"
    near = " ".join(words)
    rows = [(i, "\n".join(make(rng, rng.randint(5, 60)) for _ in range(4))) for i in range(40)]
    rows[3] = (3, make(rng, 9) + " " + passage + " " + make(rng, 30))
    rows[9] = (9, make(rng, 40) + " " + passage + " " + make(rng, 3))
    rows[11] = (11, make(rng, 10) + "\n" + line + "\n" + make(rng, 10))
    rows[20] = (20, near + "\n" + make(rng, 25))
    rows[21] = (21, line.upper())
    rows += [(50, None), (51, ""), (None, line), (52, "same short line here"), (53, "same short line here"), (54, make(rng, 30000))]
    df = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = paragraphs.duplicates(spark, df.withColumn("start", F.lit("clash")))
    got = found.collect()
    assert {r.doc_id for r in got} == {3, 9, 11, 20, 21}
    assert {r.doc_id for r in got if r.removed} == {9, 20, 21} and {r.component_doc for r in got if r.removed} == {3, 11}
    p = next(r for r in got if r.doc_id == 9)
    assert p.n_words == len(passage.split())
    out = {r.doc_id: r for r in paragraphs.remove(spark, df, found).collect()}
    before = {r[0]: r[1] for r in rows}
    assert set(out) == set(before) - {21} and df.schema == paragraphs.remove(spark, df, found).schema
    for i, r in out.items():
        if i not in (9, 20):
            assert r.text == before[i]
    assert out[20].text == before[20].split("\n")[1] and out[20].n_chars == len(out[20].text)
    assert len(out[9].text.split()) == len(before[9].split()) - p.n_words


def test_bands_reach_the_recall():
    rng = np.random.default_rng(1)
    bands, hit = paragraphs.tune(0.8, 0.9995), 0
    sets = []
    for _ in range(400):
        a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        sets += [a[:80], np.concatenate([a[:71], a[80:89]])]  # 71 common of 89
    s = paragraphs.band_signatures(np.concatenate([np.unique(x) for x in sets]), np.cumsum([0, *map(len, sets)])[:-1], bands, 4)
    hit = (s[::2] == s[1::2]).any(1).mean()
    assert hit >= 0.99 and len(word_hashes(b"a b", SOLID)[0]) == 2


def test_empty_and_cut_out(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert paragraphs.duplicates(spark, df).count() == 0
    assert paragraphs.cut_out("aé b\n\nc d", [(0, 3)]) == " b\n\nc d" and paragraphs.cut_out("a\nb\nc", [(2, 3)]) == "a\nc" and paragraphs.cut_out("ab", [(0, 2), (1, 2)]) == ""


def test_passages_side_by_side_and_in_copies(spark):
    rng = random.Random(6)
    p, q, r = make(rng, 40), make(rng, 35), make(rng, 20)
    texts = [make(rng, 12) + " " + p + " " + q + " " + make(rng, 9), make(rng, 30) + " " + p + " " + make(rng, 8), make(rng, 7) + " " + q + " " + make(rng, 31)]
    copied = make(rng, 30) + " " + r + " " + make(rng, 30)
    texts += [make(rng, 11) + " " + r + " " + make(rng, 13), copied, copied, make(rng, 80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(9)
    found = paragraphs.duplicates(spark, df, line=5, least=20)
    out = {x.doc_id: x.text.split() for x in paragraphs.remove(spark, df, found).collect()}
    cut = lambda t, x: t.replace(x, "").split()
    assert out == {0: texts[0].split(), 1: cut(texts[1], p), 2: cut(texts[2], q), 3: texts[3].split(), 4: cut(copied, r), 6: texts[6].split()}


def test_short_lines_take_part(spark):
    rng = random.Random(8)
    short = make(rng, 5)
    df = spark.createDataFrame([(i, make(rng, 15) + "\n" + short + "\n" + make(rng, 4)) for i in range(3)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in paragraphs.remove(spark, df, paragraphs.duplicates(spark, df, line=5)).collect()}
    assert [short in out[i] for i in range(3)] == [True, False, False] and len(out[2].split()) == 19


def test_short_passages_inside_lines_lose_all_words(spark):
    rng = random.Random(9)
    passages = [make(rng, n) for n in (20, 22, 25, 30, 60)]
    texts = [make(rng, rng.randint(5, 40)) + " " + p + " " + make(rng, rng.randint(5, 40)) for p in passages for _ in range(2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.text.split() for r in paragraphs.remove(spark, df, paragraphs.duplicates(spark, df, least=20)).collect()}
    assert out == {i: (t.replace(passages[i // 2], "") if i % 2 else t).split() for i, t in enumerate(texts)}


def test_a_phrase_that_stood_alone_before_hides_no_passage(spark):
    rng = random.Random(10)
    passage = make(rng, 44).split()
    texts = [make(rng, 30) + " " + " ".join(passage[i : i + 20]) + " " + make(rng, 30) for i in range(0, 25, 4)]
    texts += [make(rng, 9) + " " + " ".join(passage) + " " + make(rng, 9) for _ in range(3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.removed, r.n_words) for r in paragraphs.duplicates(spark, df, least=40).collect()}
    n = len(texts)
    assert got == {(n - 3, False, 44), (n - 2, True, 44), (n - 1, True, 44)}


def brute_lines(rows, k, least, share):
    """{(doc_id, text, line number): (first place)} of lines in components of two places or more."""
    places, sets = [], []
    for d, t in sorted({(d, t) for d, t in rows if d is not None and t}):
        for i, x in enumerate(t.split("\n")):
            w = x.lower().split()
            if len(w) >= max(least, k):
                places.append((d, t, i))
                sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
    root = list(range(len(places)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(places)):
        for j in range(i):
            if share[1] * len(sets[i] & sets[j]) >= share[0] * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(places)):
        groups.setdefault(find(i), []).append(places[i])
    return {p: g[0] for g in groups.values() if len(g) > 1 for p in g}


def test_lines_against_brute_force_with_any_number_of_files(spark):
    """Lines only (passages of ``least`` words don't occur); a hot group of near copies, repeated ids and texts."""
    rng = random.Random(12)
    base = [make(rng, rng.randint(30, 70)).split() for _ in range(25)]

    def near(w):
        w = list(w)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = make(rng, 1)
        return " ".join(w)

    rows = [(i, "\n".join([near(rng.choice(base[:1] * 20 + base)), make(rng, rng.randint(3, 30)), near(rng.choice(base))])) for i in range(150)]
    rows += [rows[3], (7, rows[9][1]), (7, make(rng, 25)), (None, rows[1][1]), (200, None), (201, ""), (202, " \n\t")]
    want = brute_lines(rows, 5, 20, (4, 5))
    assert len(want) > 120
    for parts in (1, 16, 64):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(parts)
        got = paragraphs.duplicates(spark, df, least=1000).collect()
        texts = {(r.doc_id, r.key): r.text for r in df.select("doc_id", F.xxhash64("text").alias("key"), "text").collect()}
        key = {(d, t): k for (d, k), t in texts.items()}
        # the first place is by (doc_id, key, start); brute force orders texts of one id otherwise
        place = lambda d, k, s: (d, k, texts[d, k].encode()[:s].count(b"\n"))
        groups = {}
        for p, first in want.items():
            groups.setdefault(first, []).append((p[0], key[p[0], p[1]], p[2]))
        kept = {min(g) for g in groups.values()}
        assert {(place(r.doc_id, r.text_key, r.start), r.removed) for r in got} == {(p, p not in kept) for g in groups.values() for p in g}
        assert len(got) == len(want)


def test_anchors_of_many_words_take_little_memory():
    """The windows of an anchor are looked through in parts, not copied all at once; the anchors are those of one look."""
    import tracemalloc

    h = np.random.default_rng(4).integers(0, 1 << 63, 200_000, dtype=np.uint64)
    of = np.arange(len(h)) // 70_000
    tracemalloc.start()
    value, place = paragraphs.anchors(h, of, 48)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    g = paragraphs.shingle_hashes(h, 16)
    want = sorted({i + int(g[i : i + 33].argmin()) for i in range(len(h) - 47) if of[i] == of[i + 47]})
    assert np.unique(place).tolist() == want and len(value) == len(place)
    assert peak < 30 << 20
