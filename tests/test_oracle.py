"""Every query with SQL agrees with DuckDB on the same tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import workloads

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        at = f"{p}/*" if os.path.isdir(p) else str(p)
        c.execute(f"create view {p.stem} as select * from read_parquet('{at}')")
    return c


@pytest.mark.parametrize("name", sorted(workloads.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = workloads.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(workloads.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = [tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    got = [tuple(map(_plain, r)) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(workloads.QUERIES) - set(workloads.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert workloads.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
