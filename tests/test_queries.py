"""Every registered query against its SQL text on the smallest tables."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry
from skyloom.plans import catalog
from tools.check import TABLES, canon

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in cols]).collect()
    if name not in SQL:
        assert rows
        return
    mine = Counter(tuple(canon(v) for v in r) for r in rows)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert cols == sorted(names)
    place = sorted(range(len(names)), key=lambda i: names[i])
    theirs = Counter(tuple(canon(r[i]) for i in place) for r in cur.fetchall())
    assert list((mine - theirs).elements())[:3] == [] and list((theirs - mine).elements())[:3] == []
