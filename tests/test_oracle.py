"""Every query that has SQL gives what DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _core():
    import tidemark.queries as q

    return sorted(q.oracle_sql())


@pytest.mark.parametrize("name", _core())
def test_same_as_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
