"""Every query with SQL gives the same rows as DuckDB; the others have numeric tests of their own."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

from colframe.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


#: Queries that SQL can't express, and the tests that compute their rows another way.
NUMERIC = {
    "singular_values": "test_singular_values_of_the_table",
    "conjugate_gradient": "test_conjugate_gradient_of_the_table",
    "filtfilt": "test_filtfilt_of_the_table",
    "mlp_training": "test_training_of_the_table",
    "transformer": "test_transformer_of_the_table",
}


def test_queries_without_sql_have_numeric_tests():
    import test_numeric

    assert {n for n in catalog.queries() if n not in catalog.oracle_sql()} == set(NUMERIC)
    assert all(hasattr(test_numeric, t) for t in NUMERIC.values())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(NUMERIC)))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert len({c.lower() for c in columns}) == len(columns)  # else the result can't be written
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
