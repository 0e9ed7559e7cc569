"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(x):
    if x is None or x != x:
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    try:
        return f"{float(x) + 0.0:.7g}"
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


CORE = [n for m in entry._modules() if ".llm." not in m.__name__ for n in m.QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
