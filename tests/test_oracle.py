import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal

SF = "/root/testdata/sf0.001"
SQL, QUERIES = entry.oracle_sql(), entry.queries()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(SQL) & set(QUERIES)))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(rows, df.columns) == normal(cur.fetchall(), names)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
