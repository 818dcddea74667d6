"""Every query with SQL gives what DuckDB gives."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path(os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return list(v) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(SF))
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    rows = sorted((str([plain(r[c]) for c in order]) for r in got.collect()))
    there = sorted(str([plain(dict(zip(columns, r, strict=True))[c]) for c in order]) for r in want.fetchall())
    assert rows == there and rows


@pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
