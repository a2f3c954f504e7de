import random
import re

from colframe.llm import licenses
from colframe.llm.licenses import PHRASES, TEMPLATES, Scanner


def brute(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_phrases_against_brute_force(spark):
    rng = random.Random(3)
    pool = "mit license apache general public GNU Licensed under the version é 2 MIT-License, Éa İ".split() + ["\n"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "mit", "license mit license mit license", TEMPLATES["apache"][0] * 3, "x " * 50000 + "MIT License", "mit license mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS labels", "1 AS n_words")
    got = {r.doc_id: r for r in licenses.scan(spark, df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_matching_statistics():
    s = Scanner({"b c": "x"}, {"t": ["a b c d e", "c d f"]}, least=2)
    a = s.automaton
    text = "z a b c d f b c q c d e".split()
    ids = [a.vocabulary.get(w.encode()) for w in text]
    subs = {tuple(t[i:j]) for t in ("a b c d e".split(), "c d f".split(), "b c".split()) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    v = n = 0
    for i, c in enumerate(ids):
        while v > 0 and c not in a.step[v]:
            v = a.link[v]
            n = a.size[v]
        if c in a.step[v]:
            v, n = a.step[v][c], n + 1
        assert n == max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in subs), default=0)


def test_spans_survive_edits():
    t = licenses.words(TEMPLATES["mit"][0])
    edited = [b"junk"] * 5 + t[:30] + [b"changed"] + t[31:] + [b"end"]
    places, spans = Scanner(PHRASES, TEMPLATES).scan(edited)
    assert not places and [(x[0], x[1], x[2]) for x in spans] == [("mit", 5, 4 + len(t))] and 0.95 < spans[0][3] < 1
    assert Scanner(PHRASES, TEMPLATES).scan(licenses.words("All rights reserved. plain prose of the year"))[1][0][0] == "all-rights-reserved"
    assert Scanner(PHRASES, TEMPLATES).scan(licenses.words("free of the rights to do so, and the copy of it")) == ([], [])


def test_empty(spark):
    assert licenses.scan(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_whose_predecessor_has_many_places():
    template = "p q r a1 s t u a2 v w x " + " ".join(f"b{i} c{i} d{i} s t u" for i in range(19))
    n = len(template.split())
    s = Scanner({"never seen": "x"}, {"t": [template]}, least=3, gap=2, coverage=9 / n - 1e-9)
    assert s.scan(b"p q r y s t u y v w x".split())[1] == [("t", 0, 10, 9 / n)]


def test_every_span_of_a_template_is_kept():
    t = licenses.words(TEMPLATES["mit"][0])
    part, prose = t[: len(t) * 9 // 10], [b"prose"] * 30
    for tokens, lengths in ((part + prose + t, [len(part), len(t)]), (t + prose + part, [len(t), len(part)]), (t + t + prose + part + part, [len(t), len(t), len(part), len(part)])):
        spans = [x for x in Scanner(PHRASES, TEMPLATES).scan(tokens)[1] if x[0] == "mit"]
        assert [b - a + 1 for _, a, b, _ in spans] == lengths


def test_chains_against_brute_force():
    rng = random.Random(4)
    found = 0
    for _ in range(300):
        template = [rng.choice("abcdef") for _ in range(rng.randint(6, 14))]
        text = [rng.choice([*"abcdefz", *template]) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(1, 3)):
            a = rng.randrange(len(template))
            text += template[a : a + rng.randint(2, 9)] + [rng.choice("abz") for _ in range(rng.randint(0, 3))]
        s = Scanner({"never seen": "x"}, {"t": [" ".join(template)]}, least=2, gap=2, coverage=0.4)
        got = s.scan([w.encode() for w in text])[1]
        # matches that neither side can prolong at the end, at all places of the template
        n, matches = len(template), []
        longest = [max((m for m in range(i + 2) if any(template[j : j + m] == text[i + 1 - m : i + 1] for j in range(n - m + 1))), default=0) for i in range(len(text))]
        for i, m in enumerate(longest):
            if m >= 2 and (i + 1 == len(text) or longest[i + 1] < m + 1):
                matches += [(i + 1 - m, i + 1, j, j + m) for j in range(n - m + 1) if template[j : j + m] == text[i + 1 - m : i + 1]]

        def cover(k):
            s, e, ts, te = matches[k]
            return e - s + max((cover(j) for j, (a, b, c, d) in enumerate(matches) if 0 <= s - b <= 2 and 0 <= ts - d <= 2), default=0)

        best = max(map(cover, range(len(matches))), default=0)
        if best >= 0.4 * n:
            found += 1
            assert max(x[3] for x in got) == min(1.0, best / n), (template, text)
        else:
            assert got == []
        places = sorted((a, b) for _, a, b, _ in got)
        assert all(x[1] < y[0] for x, y in zip(places, places[1:]))
    assert found > 100


def test_edited_templates_are_found_and_prose_is_not():
    rng, scanner, found, total = random.Random(6), Scanner(PHRASES, TEMPLATES), 0, 0
    vocabulary = [w for texts in TEMPLATES.values() for t in texts for w in licenses.words(t)]
    for label, texts in TEMPLATES.items():
        for t in (licenses.words(x) for x in texts):
            if len(t) < 20:
                continue
            for _ in range(5):
                edited = list(t)
                for i in rng.sample(range(len(t)), len(t) // 25):
                    edited[i] = b"edited"
                noise = [rng.choice(vocabulary) for _ in range(60)]
                total += 1
                found += label in {x[0] for x in scanner.scan(noise + edited + noise)[1]}
    assert found >= 0.95 * total
    assert not any(scanner.scan([rng.choice(vocabulary) for _ in range(2000)])[1] for _ in range(20))
