import math
import random
import zlib

import numpy as np
import pytest
from colframe.llm import packing
from colframe.llm.bpe import Encoder, vocabulary

ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "a\n  b", "a   b", "a  \n b\n\n c", "x<|endoftext|>y", "<|endoftext|>", "it's we'll 12 3.5 «été» ñandú", "中文 字 ", "a b  c", "tab\tt \t x", "\x1c a \x1d b", "🙂 🙂🙂 é ß", "A" * 300 + " " + "b" * 200]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_ids_equal_the_tokenizer(reference):
    rng, enc = random.Random(5), Encoder(vocabulary(), max_entries=50)
    texts = ODD + ["".join(rng.choice("ab é\n \t.,'s1<|>") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)


def test_fullest_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room, sums = rng.randint(0, 60), {0}
        for x, c in counts.items():
            sums = {s + k * x for s in sums for k in range(c + 1)}
        got = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(x) <= counts[x] for x in set(got))


def pack_rows(spark, rows, capacity):
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int").repartition(3)
    return df, packing.pack(spark, df, vocabulary(), end_id=0, capacity=capacity).collect()


def test_pack_is_whole_and_gapless(spark, reference):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["la", "zorp", "theand", "été"]) for _ in range(rng.choice([1, 3, 3, 3, 40]))), "clash", 1) for i in range(300)]
    rows += [(900, None, None, None), (901, "", "x", 2), (902, "word " * 500, "x", 2), (7, "twice", "x", 1), (7, "twice", "x", 1), (None, "no id", None, None)]
    _, got = pack_rows(spark, rows, 64)
    want = []
    for i, t, *_ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [0]
        cuts, b = [], len(ids)
        while b > 0:
            a = max(0, b - 64)
            cuts.append((a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            b = a
        want += [(i, k, *c) for k, c in enumerate(reversed(cuts))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 64) + 2


def test_pack_empty(spark):
    assert pack_rows(spark, [], 64)[1] == []
