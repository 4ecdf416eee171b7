"""The driver's contract on the smallest tables: every query of the core that has SQL is compared with it."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    made.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        made.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return made


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return "[" + ",".join(map(plain, value)) + "]" if isinstance(value, (list, tuple)) else str(value)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_their_sql(spark, db, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = Counter(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    want = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({registry.ORACLES[name]}) as w")
    assert got == Counter(tuple(map(plain, r)) for r in want.fetchall())
