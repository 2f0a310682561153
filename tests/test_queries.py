"""Every core query with SQL beside DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

from compare import rows
from spanwright.plans import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no tables here")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in sorted(Path(DATA).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())
