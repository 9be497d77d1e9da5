"""Every query of the problems on the smallest tables: its columns, and its SQL where there is one."""

import os

import pytest

from segloom.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {
    "p1_found": "job_id string, speaker_id int, first_seg_id bigint, last_seg_id bigint",
    "p2_found": "timeline_id bigint, seg_pos int, boundary string",
    "p3_found": "seg_id bigint",
    "p4_found": "job_id string, segment_type string, first_seg_id bigint, last_seg_id bigint",
    "p5_found": "seg_id bigint",
    "p7_ids": "doc_id bigint, ids array<int>",
    "p9_found": "doc_id_a bigint, doc_id_b bigint",
}


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, DATA)
    if name in COLUMNS:
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns) and rows
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        if file.endswith(".parquet"):
            con.execute(f"create view {file[:-8]} as select * from '{DATA}/{file}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(row[names.index(c)]) for c in df.columns) for row in cur.fetchall())
    assert sorted(tuple(plain(v) for v in row) for row in rows) == want
