import duckdb
import pytest

from blockflow.llm import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    r = c.execute(q.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert sorted((tuple(x[n] for n in columns) for x in df.collect()), key=str) == sorted((tuple(x[names.index(n)] for n in columns) for x in r.fetchall()), key=str)


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 11))
