"""Every registered query against its SQL twin, where there is one."""

import duckdb
import pytest

from opsboard.llm.queries import QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name].run(spark, sf_dir)
    names = sorted(df.columns)
    result = duck.execute(QUERIES[name].sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    theirs = [tuple(row[columns.index(n)] for n in names) for row in result.fetchall()]
    ours = [tuple(row[n] for n in names) for row in df.collect()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
    assert ours
