"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def rows_of(records):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in records)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_same_rows(spark, data, db, name):
    ours = QUERIES[name](spark, data)
    columns = sorted(ours.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = db.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    assert rows_of(tuple(r[c] for c in columns) for r in ours.collect()) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0
