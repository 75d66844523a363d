"""Rows that queries shuffle: what fills the disk as tables grow."""

import os

import numpy as np
import pytest

from dopplerlake.operators import gait, ghosts, points
from dopplerlake.plans import ingest
from dopplerlake.sources import fixtures as fx
from dopplerlake.sources import manifest as mf

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
P = "recording_id long, frame_idx long, point_idx long, x double, y double, z double"


@pytest.fixture(autouse=True)
def large(spark):
    """Plans as they are for large tables: nothing is broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def shuffles(df):
    """Rows written by each shuffle of a query, which is run for that."""
    df.collect()
    found = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append(plan.metrics().apply("shuffleRecordsWritten").value())
        if name == "ReusedExchangeExec":
            return
        below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        for p in below:
            walk(p)

    walk(df._jdf.queryExecution().executedPlan())
    return sorted(found)


def test_background_points_are_copied_less_than_twice(spark):
    rng = np.random.default_rng(1)
    cloud = lambda n: spark.createDataFrame([(1, 0, i, *map(float, r)) for i, r in enumerate(rng.uniform(-9, 9, (n, 3)))], P)
    assert sum(shuffles(points.subtract_background(cloud(300), cloud(2000)))) < 300 + 2 * 2000


def test_background_across_the_edges_of_cells(spark):
    """Coordinates in steps of 0.05 around the edges, so that many distances are the limit itself; empty and undefined ones."""
    rng = np.random.default_rng(2)
    a, b = (rng.choice([-3.0, 0.0, 3.0], (n, 3)) + rng.integers(-9, 10, (n, 3)) * 0.05 for n in (3000, 700))
    rows = [(1, 0, i, *map(float, r)) for i, r in enumerate(a)] + [(1, 0, 3000, None, 0.0, 0.0), (1, 0, 3001, float("nan"), 0.0, 0.0), (2, 0, 3002, *map(float, b[0])), (1, 0, 3003, *map(float, b[0]))]
    room = [(1, *map(float, r)) for r in np.concatenate((b, b[:50]))] + [(1, None, 0.0, 0.0), (1, float("nan"), 0.0, 0.0)]
    got = points.subtract_background(spark.createDataFrame(rows, P), spark.createDataFrame(room, "recording_id long, x double, y double, z double"))
    far = np.array([np.sqrt((d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]).min() > 0.25 for d in (b[None] - a[:, None])])
    assert 0 < far.sum() < 3000
    assert {r[0] for r in got.select("point_idx").collect()} == set(np.flatnonzero(far).tolist()) | {3000, 3001, 3002}


def test_ghost_features_shuffle_points_once(spark):
    p = fx.points(spark, SF, by=("recording_id",))
    assert shuffles(ghosts.features(p, 0.25, 0.5)) == [p.count()]


def test_envelopes_stay_where_their_frames_were_numbered(spark):
    assert shuffles(gait.smooth(fx.envelope(spark, SF))) == [fx.envelope(spark, SF).count()]


def test_runs_of_a_manifest_are_joined_once(spark):
    t = lambda schema, *rows: spark.createDataFrame(list(rows), "recording_id long, " + schema)
    rows = mf.manifest(
        t("n_frames long, n_points long, bytes_skipped long, resyncs long, frames_lost long, count_mismatches long, verdict string", (1, 10, 50, 7, 1, 2, 0, "x"), (2, 5, 0, 0, 0, 0, 0, "y"), (None, 1, 0, 0, 0, 0, 0, "z")),
        t("anomaly string, n long", (1, "b", 2)), t("has_map boolean, has_profile boolean, tier string", (1, True, True, "B")), t("range_bins long", (1, 128)), t("cadence double", (1, 100.0)), t("cadence_spectral double", (1, 80.0)),
        t("method string, n long, tagged long, fraction double", (1, "m0", 4, 1, 0.25), (1, "m1", 4, 2, 0.5), (3, "m0", 4, 4, 1.0), (None, "m0", 1, 1, 1.0)), t("valid_fraction double", (1, 0.5)), t("v_min double", (1, 0.3)),
    )
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Join") <= 9
    got = {(r["recording_id"], r["bucket"], r["method"] and tuple(r["method"])) for r in rows.collect()}
    assert got == {(1, mf.RAW, None), (2, mf.RAW, None), (None, mf.RAW, None), (1, "m0", ("m0", 4, 1, 0.25)), (1, "m1", ("m1", 4, 2, 0.5))}


def test_tags_counted_by_frame_are_those_of_all_labels(spark):
    want = ghosts.tagged(ghosts.labels(ghosts.features(fx.points(spark, SF), 0.25, 0.5), 0.5)).where("recording_id is not null")
    got = ghosts.tagged_of(ingest._frame_counts(spark, SF))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and got.count() > 0
