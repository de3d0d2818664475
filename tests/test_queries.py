import duckdb
import pytest

from blockflow import queries as q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    r = duck.execute(q.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(row[names.index(c)] for c in columns) for row in r.fetchall()), key=str)
