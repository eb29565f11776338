"""Every query with SQL gives the rows DuckDB gives on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from noticelake import plans

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value if isinstance(value, bool | int | str) else str(value)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cursor = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in cursor.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    assert got == want


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
