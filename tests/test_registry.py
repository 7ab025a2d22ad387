"""Registered queries against their SQL oracles at sf0.001 (EXAMLOOM_ALL=1 for every query)."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["topic_stats", "score_session", "sm2_fold", "exam_random", "merge_sessions", "mark_replay", "classify_docs", "debounce_flush"]
NAMES = sorted(entry.queries()) if os.environ.get("EXAMLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
