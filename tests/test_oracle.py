"""Every query with SQL of its own gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from parcelspark import registry

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _key(row):
    return tuple((x is None, round(x, 4) if isinstance(x, float) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_rows_match(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toArrow()
    want = duck.execute(registry.ORACLE[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = sorted(got.column_names)
    a, b = (sorted(zip(*(t.column(c).to_pylist() for c in columns), strict=True), key=_key) for t in (got, want))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            if isinstance(u, float) and v is not None:
                assert math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9), (name, x, y)
            else:
                assert str(u).removesuffix("+00:00") == str(v).removesuffix("+00:00"), (name, x, y)
