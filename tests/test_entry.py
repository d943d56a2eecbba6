"""The registered queries against their SQL."""

import os

import pytest

import __spark_entry__ as entry
from millrace import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_engine_query_has_sql():
    assert set(engine.QUERIES) == set(engine.ORACLE)
    assert set(engine.QUERIES) <= set(entry.queries()) and set(engine.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = duck.execute(engine.ORACLE[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rows.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
def test_entry(spark):
    assert entry.entry(spark).count() == 3
