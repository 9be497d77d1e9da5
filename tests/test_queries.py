"""Every core query against its SQL, and the entry module's contract."""

import os

import pytest

import __spark_entry__ as entry
from segloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return repr([plain(x) for x in v]) if isinstance(v, list | tuple) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in cur.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in df.collect()) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_listing_is_newest_first(spark):
    """The order itself, which a comparison of rows cannot see; entries without a time come last."""
    from pyspark.sql import functions as F

    from segloom.runtime import load

    dates = [r.date for r in registry.queries()["cache_list"](spark, DATA).collect()]
    given = [r.date for r in load(spark, DATA, "cache_meta").select(F.substring("processed_at", 1, 10).alias("date")).collect()]
    known = [d for d in dates if d is not None]
    assert known == sorted(known, reverse=True) and dates == known + [None] * (len(dates) - len(known))
    assert sorted(known) == sorted(d for d in given if d is not None)
