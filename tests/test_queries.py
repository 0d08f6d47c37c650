"""Every registered query runs on the smallest data and equals its SQL twin."""

import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest
from conftest import SMALL

from plover.queries import registry


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and v != v else round(v, 6) + 0.0 if isinstance(v, float) else v


def same_as_sql(spark, con, query, sql):
    df = query(spark, SMALL)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.collect())
    cur = con.execute(sql)
    at = [c[0] for c in cur.description]
    assert sorted(at) == sorted(df.columns)
    assert got == sorted(repr(tuple(plain(r[at.index(c)]) for c in df.columns)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, con, name):
    same_as_sql(spark, con, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    for path in glob.glob(os.path.dirname(registry.__file__) + "/../**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "plover.llm" not in open(path).read(), path
