"""The features of all gesture modes equal their SQL in every printed digit."""

import glob
import os

import duckdb

from dopplerlake.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KEYS = ("mode", "recording_id", "frame_idx")


def test_modes_equal_sql_to_the_last_digit(spark):
    """The map's Doppler is rounded before it is correlated; unrounded, the sixth digit of the correlation differed."""
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(registry.oracle_sql()["f14_modes"])
    names = [d[0] for d in want.description]
    want = {tuple(r[k] for k in KEYS): r for r in (dict(zip(names, x)) for x in want.fetchall())}
    got = {tuple(r[k] for k in KEYS): r.asDict() for r in registry.queries()["f14_modes"](spark, SF).collect()}
    assert got.keys() == want.keys() and {k[0] for k in got} == {"onchip", "points", "heatmap"}
    bad = [(k, c, got[k][c], want[k][c]) for k in got for c in names if c not in KEYS and abs(got[k][c] - want[k][c]) > 1e-9]
    assert not bad, (len(bad), bad[:3])
