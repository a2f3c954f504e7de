"""The registered queries on the smallest tables: DuckDB's rows where there is SQL, held-out quality where labels decide."""

from collections import Counter

import duckdb
import pytest

from colframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    df, found = queries.queries()[name](spark, SF), duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    exact = lambda r: tuple(round(v, 12) if isinstance(v, float) else v for v in r)
    assert Counter(map(exact, df.select(*names).collect())) == Counter(map(exact, found.fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_languages_of_held_out_documents(spark, duck):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = [r for r in queries.op6_language_id(spark, SF).collect() if r.held_out]
    assert got and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)
