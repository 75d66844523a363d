"""Every registered query with SQL against DuckDB over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from dopplerlake.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    return (1, round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else (2, str(v))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(a - b) <= 2e-6 * max(1, abs(a))
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    if name not in SQL:
        df.count()
        return
    got, cols = df.collect(), sorted(df.columns)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = [dict(zip(names, r)) for r in want.fetchall()]
    assert len(rows) == len(got) and rows
    a = sorted(([r[c] for c in cols] for r in got), key=lambda r: [key(v) for v in r])
    b = sorted(([r[c] for c in cols] for r in rows), key=lambda r: [key(v) for v in r])
    bad = [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y))]
    assert not bad, (cols, len(bad), bad[:3])
