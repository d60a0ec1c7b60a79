"""Every registered query of the behaviour-analytics operators against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from loomwatch.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, str)):
        return value
    number = float(value) if isinstance(value, float) or type(value).__name__ == "Decimal" else None
    return str(value) if number is None else None if math.isnan(number) else round(number, 5)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == expected
