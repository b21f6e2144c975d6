"""Every query with SQL against DuckDB on the smallest tables; the others return rows."""

import duckdb
import pytest


import __spark_entry__ as entry
from tramline import plans

DATA = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    one = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(one, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    if name in plans.ORACLE_SQL:
        want = duck.sql(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).columns == ["realm", "topic", "policy", "deliveries", "events"]
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLE_SQL) <= set(entry.oracle_sql())
