import pytest
from pyspark.sql import functions as F

from colframe.llm import tokencounts
from colframe.llm.bpe import vocabulary


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_token_counts(spark, reference):
    texts = ["a b c", "a b c", None, "", "one two three four five six", "x " * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    n = [len(reference.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r.n_tokens: r for r in tokencounts.length_table(spark, df, vocabulary()).collect()}
    assert sorted(got) == sorted(set(n))
    for x, r in got.items():
        assert (r.n_docs, r.docs_at_most, r.docs_longer) == (n.count(x), sum(v <= x for v in n), sum(v > x for v in n))
        assert r.total_tokens == sum(v for v in n if v <= x) and r.truncated_total == sum(min(v, x) for v in n)
        assert r.quantile == pytest.approx(r.docs_at_most / len(n))
    assert tokencounts.length_table(spark, df.filter(F.lit(False)), vocabulary()).count() == 0


def test_clashing_columns_nulls_and_many_files(spark, reference):
    texts = [None, None, "", " ", "a", "a"] + [" ".join(["word"] * n) for n in (3, 3, 3, 1500, 1500, 5000)]
    plain = spark.createDataFrame([(t,) for t in texts], "text string")
    wide = plain.select("text", F.lit(7).alias("n_tokens"), F.lit("x").alias("block"), F.lit(None).cast("long").alias("n_docs")).repartition(20)
    want = sorted(map(tuple, tokencounts.length_table(spark, plain, vocabulary()).collect()))
    assert sorted(map(tuple, tokencounts.length_table(spark, wide, vocabulary()).collect())) == want and sum(r[1] for r in want) == len(texts)
    only = tokencounts.length_table(spark, spark.createDataFrame([(None,), (None,)], "text string"), vocabulary()).collect()
    assert [tuple(r) for r in only] == [(0, 2, 2, 0, 0, 0, 1.0)]
