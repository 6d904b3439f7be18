import duckdb
import pytest

from textloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle():
    assert catalogue.QUERIES.keys() == catalogue.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_agrees_with_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, DIR)
    want = oracle.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda found, names: sorted(str(tuple(dict(zip(names, r))[c] for c in columns)) for r in found)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and catalogue.QUERIES.keys() <= entry.queries().keys()
