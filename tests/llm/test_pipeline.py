"""Stages of the pipeline against brute force on a small corpus."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = random.Random(11)
    word = lambda: rng.choice("bcdfghlmnprst") + rng.choice("aeiou") + rng.choice("bcdfghlmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "s"])
    make = lambda n: " ".join(word() for _ in range(n))
    passage, item = make(80), make(30)
    texts = {i: "\n".join(make(rng.randint(25, 60)) for _ in range(3)) for i in range(60)}
    texts[61] = texts[4]
    texts[62] = " ".join(texts[5].split()[:-1] + ["other"])
    texts[7] = make(20) + " " + passage + " " + make(20)
    texts[40] = make(15) + " " + passage + " " + make(25)
    texts[41] = make(30) + "\n" + " ".join(item.split()[5:25]) + " " + make(30)
    texts |= {70: None, 71: "", 72: "12345 6789 !!! ...", 73: "word " * 9000}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    d = tmp_path_factory.mktemp("corpus")
    pq.write_table(pa.table({c: [r[j] for r in rows] for j, c in enumerate(COLUMNS)}), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1, 2], "text": [item, None]}), d / "benchmark.parquet")
    return str(d), {r[0]: r for r in rows}, passage


def test_stages(spark, corpus):
    d, rows, passage = corpus
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r.doc_id: tuple(r) for r in docs.collect()})
    language, copies, cuts, clean = kept
    assert set(language) == set(rows) - {70, 71, 72} and all(language[i] == rows[i] for i in language)
    assert set(copies) == set(language) - {61, 62} and all(copies[i] == rows[i] for i in copies)
    assert set(cuts) == set(copies)
    assert all(cuts[i][1] == copies[i][1] for i in cuts if i not in (40, 73)) and passage in cuts[7][1] and passage not in cuts[40][1]
    assert len(cuts[40][1].split()) <= 15 + 25 + 20 and cuts[40][4] == len(cuts[40][1])
    assert set(clean) == set(cuts) - {41}
    pieces = cp.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in pieces} == set(clean)


def test_repeated_and_null_rows(spark, corpus):
    d, rows, _ = corpus
    twice = spark.createDataFrame([rows[1], rows[1], rows[2], (None, rows[3][1], None, None, None)], spark.read.parquet(f"{d}/documents.parquet").schema)
    got = sorted(((r.doc_id, r.text) for r in cp.ngram_jaccard_join(spark, twice, d).collect()), key=str)
    assert got == sorted([(1, rows[1][1]), (2, rows[2][1]), (None, rows[3][1])], key=str)
    for _, stage in cp.STAGES:
        assert stage(spark, twice.where("false"), d).count() == 0


def test_run(spark, corpus):
    d, *_ = corpus
    assert cp.run(spark, d).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_batches_are_bounded_in_bytes(spark):
    """Executors and workers hold whole batches, so their size is bounded whatever the length of rows; less stays."""
    from colframe import shipping

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    try:
        for given, want in (("64MB", shipping.BATCH), ("1m", 1 << 20), ("2048", 2048)):
            spark.conf.set(name, given)
            shipping.ship(spark)
            long = spark.range(0, 1500, 1, 1).selectExpr("repeat('word ', 2000) as text")
            got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
            assert max(got) <= want + 40_000 and sum(got) >= 1500 * 10_000
    finally:
        spark.conf.set(name, before)


def test_workers_give_up_what_other_work_left():
    """A stage's worker may have packed an earlier run; its tokenizer would count as memory of every later stage."""
    from colframe.llm import bpe
    from colframe.llm.common import lean

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["n"])
    bpe._encoders["left"] = object()
    got = list(lean(lambda batches: ((len(bpe._encoders), b.num_rows) for b in batches))(iter([batch, batch])))
    assert got == [(0, 2), (0, 2)]
