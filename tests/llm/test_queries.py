import duckdb
import pytest

from textloom.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    df = QUERIES[name](spark, DIR)
    got = sorted(str(tuple(r)) for r in df.collect())
    with duckdb.connect() as c:
        for table in ("documents", "pages", "benchmark", "conversations"):
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DIR}/{table}.parquet')")
        said = c.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})")
        assert got == sorted(map(str, said.fetchall())) and got


def test_quality_sql_on_shared_lines(spark, tmp_path):
    """The SQL's line limits, on the rows that the brute force is held to."""
    from test_quality import ROWS, frame

    path = f"{tmp_path}/documents.parquet"
    frame(spark, ROWS).coalesce(1).write.parquet(path)
    df = QUERIES["op7_quality"](spark, str(tmp_path))
    got = sorted(str(tuple(r)) for r in df.collect())
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
        assert got == sorted(map(str, c.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op7_quality']})").fetchall()))
