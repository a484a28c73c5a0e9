"""Every query against its SQL, on the smallest tables; what has no SQL must run."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for t in TABLES:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda x: repr(float(x) + 0.0) if isinstance(x, float) else str(x).removesuffix("+00:00")
    return sorted(tuple(show(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", OWN)
def test_like_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_flagship(spark):
    assert len(entry.entry(spark).collect()) == 10


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
