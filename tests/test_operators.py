"""Closed-form cases of the radar operators: ties, nulls, empty frames, ends of windows, and loss in captures."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dopplerlake.operators import angle, audit, gait, gesture, ghosts, maps, points, rawadc, tracking
from dopplerlake.sources import captures, wire
from dopplerlake.sources import fixture_captures as made
from dopplerlake.streaming import apps, stateful

P = "recording_id long, frame_idx long, point_idx long, t double, x double, y double, z double, v double, snr_db double, noise_db double"


def cloud(spark, rows):
    """rows: (frame, x, y, v, snr)"""
    seen, out = {}, []
    for f, x, y, v, s in rows:
        i = seen[f] = seen.get(f, -1) + 1
        out.append((1, f, i, f * 0.04, float(x), float(y), 0.0, float(v), None if s is None else float(s), 0.0))
    return spark.createDataFrame(out, P)


def values(df, *cols):
    return [tuple(r) for r in df.orderBy(*cols).collect()]


def test_geometry_follows_the_boresight_convention(spark):
    r = points.geometry(cloud(spark, [(0, 1, 1, 0, 10), (0, -2, 0, 0, None)])).orderBy("point_idx").collect()
    assert r[0]["azimuth_deg"] == pytest.approx(45) and r[1]["azimuth_deg"] == pytest.approx(-90)
    assert r[0]["peak_db"] == 10 and r[1]["peak_db"] is None


def test_flatten_drops_side_info_of_another_length(spark):
    df = spark.createDataFrame([(1, 0, [(1.0, 2.0, 3.0, 4.0)], [(9.0, 1.0)]), (1, 1, [(1.0, 2.0, 3.0, 4.0)], []), (1, 2, [], [])], "recording_id long, frame_idx long, points array<struct<x:double,y:double,z:double,v:double>>, side array<struct<snr_db:double,noise_db:double>>")
    assert values(points.flatten(df).select("frame_idx", "snr_db"), "frame_idx") == [(0, 9.0), (1, None)]


def test_time_base_falls_back_to_rows(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 8), (2, 0, 5), (2, 1, 3), (2, 2, 4)], "recording_id long, frame_idx long, frame_number long")
    got = [round(r[0], 6) for r in points.time_base(df, 0.1).orderBy("recording_id", "frame_idx").select("t").collect()]
    assert got == [0.0, 0.3, 0.0, 0.1, 0.2]


def test_notch_rounds_half_to_even(spark):
    assert points.notch(cloud(spark, [(0, 0, 1, 0.25, 1), (0, 0, 1, 0.75, 1), (0, 0, 1, -0.3, 1)]), 0.5, 0).count() == 2


def test_strongest_orders_ties_by_wire_order(spark):
    got = points.strongest(cloud(spark, [(0, 1, 1, 0, 5), (0, 2, 1, 0, None), (0, 3, 1, 0, 5), (0, 4, 1, 0, 7)]), 3).orderBy("place").collect()
    assert [r["point_idx"] for r in got] == [3, 0, 2]


def test_background_at_the_very_distance_is_removed(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "recording_id long, x double, y double, z double")
    got = points.subtract_background(cloud(spark, [(0, 0.25, 0, 0, 1), (0, 0.26, 0, 0, 1), (0, -0.2, -0.2, 0, 1), (0, 0.1, 0.1, 0, 1)]), b)
    assert [r[0] for r in got.orderBy("point_idx").select("x").collect()] == [0.26, -0.2]


def test_background_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(-2, 2, (400, 3)), rng.uniform(-2, 2, (120, 3))
    pdf = spark.createDataFrame([(1, 0, i, 0.0, *map(float, r), 0.0, 0.0, 0.0) for i, r in enumerate(a)], P)
    got = {r[0] for r in points.subtract_background(pdf, spark.createDataFrame([(1, *map(float, r)) for r in b], "recording_id long, x double, y double, z double")).select("point_idx").collect()}
    assert got == {i for i, r in enumerate(a) if np.sqrt(((b - r) ** 2).sum(1)).min() > 0.25}


def test_an_incomplete_mask_is_an_error(spark):
    p = cloud(spark, [(0, 1, 1, 0, 1), (0, 2, 1, 0, 1)])
    labels = spark.createDataFrame([(1, 0, 0, False)], "recording_id long, frame_idx long, point_idx long, is_ghost boolean")
    with pytest.raises(Exception, match="no label"):
        points.keep(p, labels).collect()


def test_accumulated_points_equal_the_copied_ones(spark):
    p = cloud(spark, [(f, f * 0.5, 10 - f, 0, 1) for f in (0, 0, 3, 4, 9)])
    want = points.accumulate(p, 3, 11).groupBy("recording_id", "shown_at").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.max("y").alias("max_y"))
    assert values(points.accumulated(p, 3, 11), "shown_at") == values(want, "shown_at") and want.count() == 10


def test_density_closes_the_last_bin_and_widens_a_flat_axis(spark):
    d = points.density(cloud(spark, [(0, 0, 1, 0, 1), (1, 0, 1, 5, 1), (2, 0, 1, 10, 1)]), F.col("v"), F.col("x"), 10, 4)
    assert values(d.select("bx", "by", "n"), "bx") == [(0, 2, 1), (5, 2, 1), (9, 2, 1)]


def test_unwrap_counts_rollovers_only(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([4_000_000_000, 100, 50, 3_000_000_000, 0])], "recording_id long, frame_idx long, cycles long")
    got = [round(r[0] * 200e6) for r in points.unwrap_clock(df).orderBy("frame_idx").select("hw_t").collect()]
    assert got == [4_000_000_000, 2**32 + 100, 2**32 + 50, 2**32 + 3_000_000_000, 2 * 2**32]


def test_energy_is_the_same_along_both_axes(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(1, i, rng.uniform(0, 9, 64).tolist()) for i in range(5)], "recording_id long, frame_idx long, rd array<double>")
    rt = {r[0]: r[1] for r in maps.range_time_dense(df, 8, 8).groupBy("frame_idx").agg(F.sum("value")).collect()}
    vt = {r[0]: r[1] for r in maps.velocity_time_dense(df, 8, 8).groupBy("frame_idx").agg(F.sum("value")).collect()}
    assert rt.keys() == vt.keys() and all(rt[k] == pytest.approx(vt[k]) for k in rt)
    back = maps.shift_doppler(maps.shift_doppler(df, 8), 8)
    assert values(back.select("frame_idx", "rd"), "frame_idx") == values(df.select("frame_idx", "rd"), "frame_idx")


def test_missing_cells_count_as_zero(spark):
    df = spark.createDataFrame([(1, 0, [1.0, float("nan"), None, 2.0])], "recording_id long, frame_idx long, rd array<double>")
    assert [r["value"] for r in maps.range_time_dense(df, 2, 2).orderBy("bin").collect()] == [1.0, 2.0]


def test_display_limits_without_finite_cells(spark):
    df = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, float("nan"))], "recording_id long, frame_idx long, bin long, value double")
    assert tuple(maps.display_limits(df).first()) == (1, 0.0, 1.0)


def test_other_background_geometry_is_an_error(spark):
    s = "recording_id long, frame_idx long, range_bin long, dop_bin long, value double"
    with pytest.raises(Exception, match="geometry"):
        maps.subtract_empty_scene(spark.createDataFrame([(1, 0, 3, 0, 1.0)], s), spark.createDataFrame([(1, 0, 2, 0, 1.0)], s)).collect()


def test_a_track_without_values_is_an_error(spark):
    t = spark.createDataFrame([(1, 0, None)], "recording_id long, frame_idx long, range_m double")
    with pytest.raises(Exception, match="track has no value"):
        maps.following_velocity_time(cloud(spark, [(0, 1, 1, 0, 1)]), t, 0.5, 16).collect()


def test_ghost_features(spark):
    p = cloud(spark, [(0, 0, 1, 0, 10), (0, 0, 1, 0, 20), (0, 0, 2, 0, 12), (1, 0, 3, 0, None)])
    f = {(r["frame_idx"], r["point_idx"]): r for r in ghosts.features(p, 0.25, 0.5).collect()}
    assert f[0, 0]["secondary"] and not f[0, 1]["secondary"] and f[0, 0]["cocell"] == 2
    assert f[0, 0]["d_range"] == pytest.approx(0) and f[0, 2]["d_range"] == pytest.approx(1)
    assert f[1, 0]["d_range"] == 0 and f[1, 0]["excess_db"] == 0


def test_consensus_is_within_its_voters(spark):
    rng = np.random.default_rng(3)
    p = cloud(spark, [(int(rng.integers(0, 20)), rng.normal(), rng.uniform(0.5, 6), rng.choice([0.0, 0.5, 1.0]), rng.uniform(0, 30)) for _ in range(300)])
    w = ghosts.widen(ghosts.features(p, 0.25, 0.5), 0.5)
    assert w.where("method5 and not (method2 or method3 or method4)").count() == 0
    a = {(r["a"], r["b"]): r["jaccard"] for r in ghosts.agreement(w, list(ghosts.METHODS)).collect()}
    assert a["method0", "method0"] is None and a["method1", "method1"] == 1.0


def test_own_methods_can_be_registered(spark):
    @ghosts.register("far")
    def far(dv):
        return F.lit(1.0), F.col("range_m") > 2

    try:
        p = ghosts.features(cloud(spark, [(0, 0, 1, 0, 10), (0, 0, 3, 0, 20)]), 0.25, 0.5)
        assert [r["is_ghost"] for r in ghosts.labels(p, 0.5, ["far"]).orderBy("point_idx").collect()] == [False, True]
    finally:
        del ghosts.METHODS["far"]


S = "recording_id long, frame_idx long, t double, v double"


def series(spark, vs, period=0.5):
    return spark.createDataFrame([(1, i, i * period, v) for i, v in enumerate(vs)], S)


def test_hysteresis_ends_the_frame_before_the_drop(spark):
    got = gait.segments(series(spark, [0.0, 0.3, 0.4, 0.25, 0.3, None, 0.5, 0.36, 0.1])).collect()
    assert [(r["first"], r["last"]) for r in got] == [(2, 4)]


def test_smoothing_fills_a_gap_with_a_neighbour(spark):
    assert [r["v"] for r in gait.smooth(series(spark, [None, None, 3.0, 5.0])).orderBy("frame_idx").collect()] == [None, 3.0, 4.0, 4.0]


def test_peaks_by_height_distance_prominence():
    v = np.array([0, 1, 0, 3, 3, 0, 2, 1.9, 2.1, 0.0])
    assert gait.pick_peaks(v, 0.5, 1, 1e-6).tolist() == [1, 3, 6, 8]
    assert gait.pick_peaks(v, 0.5, 3, 1e-6).tolist() == [3, 8]
    assert gait.pick_peaks(v, 0.5, 1, 0.5).tolist() == [1, 3, 8]
    assert gait.pick_peaks(np.zeros(5), 0.0, 1, 0.0).tolist() == []


def plain_peaks(v, height, distance, prominence):
    """By scanning the whole series for each peak."""
    n, peaks, i = len(v), [], 1
    while i < n - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if j < n - 1 and v[j + 1] < v[i]:
                peaks.append((i + j) // 2)
            i = j
        i += 1
    p = np.array([x for x in peaks if v[x] >= height], int)
    alive = np.ones(len(p), bool)
    for i in np.argsort(v[p], kind="stable")[::-1]:
        if alive[i]:
            near = np.abs(p - p[i]) < distance
            near[i] = False
            alive &= ~near
    out = []
    for x in p[alive]:
        a, b = np.flatnonzero(v[:x][::-1] > v[x]), np.flatnonzero(v[x + 1 :] > v[x])
        base = max(v[:x][::-1][: a[0] if len(a) else None].min(initial=v[x]), v[x + 1 :][: b[0] if len(b) else None].min(initial=v[x]))
        if v[x] - base >= prominence:
            out.append(int(x))
    return out


def test_peaks_against_scans():
    rng = np.random.default_rng(12)
    for k in range(200):
        v = np.round(rng.uniform(0, 3, int(rng.integers(0, 120))), int(rng.integers(0, 3)))
        height, distance, prominence = float(rng.uniform(0, 1)), int(rng.integers(1, 9)), float(rng.choice([1e-6, 0.3, 1.0]))
        assert gait.pick_peaks(v, height, distance, prominence).tolist() == plain_peaks(v, height, distance, prominence), k


def test_peaks_of_a_long_recording_take_one_pass():
    import time

    took = []
    for n in (82_496, 4 * 82_496):
        v = np.abs(np.sin(np.arange(n) / 5)) + np.linspace(0, 1, n)  # each peak is higher than all before it
        began = time.perf_counter()
        assert len(gait.pick_peaks(v, 0.2, 3, 1e-6)) > n / 20
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.05)


def test_steps_query_against_scans(spark):
    """The steps of every recording of the table, with thresholds worked out here."""
    from dopplerlake.plans import registry
    from dopplerlake.sources import fixtures as fx

    sf = "/root/testdata/sf0.001"
    rows = gait.smooth(fx.envelope(spark, sf)).orderBy("recording_id", "frame_idx").toPandas()
    walks = {rec: list(zip(w["first"], w["last"])) for rec, w in gait.segments(gait.smooth(fx.envelope(spark, sf))).toPandas().groupby("recording_id")}
    want = set()
    for rec, x in rows.groupby("recording_id"):
        v, known = x["v"].fillna(0.0).to_numpy(), x["v"].dropna().to_numpy()
        dt = float(np.median(np.diff(x["t"])))
        q = np.percentile(known, [25, 75])
        for i in plain_peaks(v, 0.20, int(max(1, np.rint(0.25 / dt))), max(0.15 * (q[1] - q[0]), 1e-6)):
            frame = int(x["frame_idx"].iloc[i])
            if rec not in walks or any(a <= frame <= b for a, b in walks[rec]):
                want.add((int(rec), frame))
    assert {(r["recording_id"], r["frame_idx"]) for r in registry.queries()["g07_steps"](spark, sf).collect()} == want and want


def test_steps_outside_segments_stay_if_there_are_none(spark):
    s = series(spark, [0.0, 0.3, 0.0, 0.3, 0.0, 0.3, 0.0])
    none = gait.segments(s)
    assert none.count() == 0 and gait.steps(s, none).count() == 3
    m = gait.metrics(s, none, gait.steps(s, none)).first()
    assert m["n_steps"] == 3 and m["cadence"] == 0 and m["cv_percent"] is None


def test_spectral_cadence_of_a_pure_tone(spark):
    period = 0.1
    s = series(spark, [1 + math.sin(2 * math.pi * 2.0 * i * period) for i in range(100)], period)
    r = gait.spectral_cadence(s, period).first()
    assert r["cadence_spectral"] == pytest.approx(120) and r["confidence"] > 0.4


def test_short_recordings_have_no_spectral_cadence(spark):
    rows = [(1, i, i * 0.1, 1.0 * (i % 2)) for i in range(7)] + [(2, i, i * 0.1, 1.0 * (i % 4)) for i in range(8)] + [(3, i, i * 0.1, None) for i in range(40)]
    got = {r["recording_id"]: (r["cadence_spectral"], r["confidence"]) for r in gait.spectral_cadence(spark.createDataFrame(rows, S), 0.1).collect()}
    assert got[1] == (None, 0.0) and got[2][0] == pytest.approx(150) and got[3][1] == 0.0
    m = spark.createDataFrame([(1, 30.0), (2, 120.0)], "recording_id long, cadence double")
    d = gait.disagreement(m, gait.spectral_cadence(spark.createDataFrame(rows, S), 0.1))
    assert {r["recording_id"]: r["disagreement_percent"] for r in d.collect()} == {1: None, 2: pytest.approx(25)}


def test_robust_mask_without_spread(spark):
    df = spark.createDataFrame([(1, 0, i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0])], "recording_id long, frame_idx long, bin long, value double")
    assert [r["kept"] for r in gait.robust_mask(df).orderBy("bin").collect()] == [False, False, False, True]


def test_point_envelope_cases(spark):
    spine = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "recording_id long, frame_idx long")
    e = gait.point_envelope(cloud(spark, [(0, 0, 1, -2, 1), (0, 0, 1, 1, 1), (2, 0, 1, 1, 1), (2, 0, 1, 1, 1), (2, 0, 1, 1, 1)]), spine)
    assert [r["v"] for r in e.orderBy("frame_idx").collect()] == [2.0, None, 1.0]


def test_beamforming_matches_a_transform(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=8) + 1j * rng.normal(size=8)
    df = spark.createDataFrame([(1, 0, 0, i, float(c.real), float(c.imag)) for i, c in enumerate(z)], "recording_id long, frame_idx long, range_bin long, ant long, re double, im double")
    got = [r["mag"] for r in angle.beamform(df).orderBy("angle_bin").collect()]
    assert np.allclose(got, np.abs(np.fft.fftshift(np.fft.fft(z, 64)))[1:][::-1])
    w = angle.grid_weights(spark, 16, 0.5, 4).groupBy("gx", "gy").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1) for r in w)


def test_azimuth_symbols_by_transmitters(spark):
    cells = spark.createDataFrame([(rec, 0, 0, ant, float(ant), 0.0) for rec in range(1, 8) for ant in range(12)], "recording_id long, frame_idx long, range_bin long, ant long, re double, im double")
    configs = [(1, 1, [0, -1, -1]), (2, 2, [0, 1, -1]), (3, 2, [-1, 0, 1]), (4, 2, [1, -1, 0]), (5, 3, [0, 2, 1]), (6, 1, [-1, 0, -1]), (7, 2, [0, 1, 2])]
    table = spark.createDataFrame([(rec, n, 4, 4 * n, slots) for rec, n, slots in configs], "recording_id long, n_tx int, n_rx int, n_virtual int, slots array<int>")
    got = {}
    for r in angle.azimuth_symbols(cells, table).orderBy("ant").collect():
        got.setdefault(r["recording_id"], []).append(int(r["re"]))
    assert got == {1: [3, 1], 2: [7, 5], 3: [7, 5, 3, 1], 4: [3, 1], 5: [7, 5, 11, 9]}


def test_angle_moments_by_definition(spark):
    """Each peak by summing over all angles, the strongest cells one by one."""
    rng = np.random.default_rng(14)
    rows, want = [], {}
    for f in range(6):
        det, cube = np.round(rng.uniform(0, 9, (10, 4)), 1), rng.normal(size=(10, 4, 4)) + 1j * rng.normal(size=(10, 4, 4))
        if f == 5:
            det[:] = 0
        rows += [(1, f, r, d, cube[r, d].real.tolist(), cube[r, d].imag.tolist(), float(det[r, d])) for r in range(10) for d in range(4)]
        work, sums = det.copy(), np.zeros(5)
        work[8:] = 0
        for _ in range(10):
            r, d = np.unravel_index(int(np.argmax(work)), work.shape)
            c = cube[r, d]
            x = np.array([[-c[3], c[2]], [-c[1], c[0]]]) / 64
            k = np.arange(32)
            m = np.abs(np.einsum("pq,ap,bq->ab", x, np.exp(-2j * np.pi * np.outer(k, [0, 1]) / 32), np.exp(-2j * np.pi * np.outer(k, [0, 1]) / 32)))
            a, b = (int(t) - 32 if t > 15 else int(t) for t in np.unravel_index(int(np.argmax(m)), m.shape))
            w = work[r, d]
            sums += w * np.array([1, a, b, a * a, b * b])
            work[r, d] = 0
        n = sums[0]
        want[f] = (0, 0, 0, 0) if n == 0 else (sums[1] / n, sums[2] / n, sums[3] / n - (sums[1] / n) ** 2, sums[4] / n - (sums[2] / n) ** 2)
    df = spark.createDataFrame(rows, "recording_id long, frame_idx long, range_bin long, dop_bin long, re array<double>, im array<double>, value double")
    for r in gesture.angle_moments(df).collect():
        assert np.allclose((r["azimuth"], r["elevation"], r["azimuth_spread"], r["elevation_spread"]), want[r["frame_idx"]]), r["frame_idx"]


def test_gesture_modes(spark):
    rng = np.random.default_rng(15)
    n = 40
    board = spark.createDataFrame([(1, f, *rng.normal(size=10).tolist()) for f in range(n)], "recording_id long, frame_idx long, " + ", ".join(f"{c} double" for c in gesture.NAMES))
    pts = board.drop("correlation").withColumn("azimuth", F.col("azimuth") * 3)
    heat = board.select("recording_id", "frame_idx", *gesture.NAMES[:5]).where("frame_idx >= 2")
    points_mode = gesture.features_of("points", points=pts).orderBy("frame_idx").collect()
    x = np.array([[r["azimuth"], r["doppler"]] for r in points_mode])
    assert [r["correlation"] for r in points_mode[:19]] == [0] * 19
    assert points_mode[30]["correlation"] == pytest.approx(np.corrcoef(x[11:31].T)[0, 1])
    heat_mode = gesture.features_of("heatmap", points=pts.where("frame_idx % 2 = 0"), heatmap=heat).orderBy("frame_idx").collect()
    assert len(heat_mode) == n - 2 and heat_mode[1]["azimuth"] == 0 and heat_mode[2]["azimuth"] == pytest.approx(points_mode[4]["azimuth"])
    assert gesture.features_of("onchip", board=board).count() == n
    with pytest.raises(ValueError, match="mode"):
        gesture.features_of("radar")
    layers = [(rng.normal(size=(3, 90)), np.zeros(3))]
    told = gesture.recognise("points", gesture.features_of("points", points=pts), layers, [0.0] * 6, [1.0] * 6, thresholds=(0.2,) * 3, votes=(2,) * 3).orderBy("frame_idx").collect()
    assert [r["ready"] for r in told] == [False] * 14 + [True] * (n - 14) and all(r["state"] == 0 and not r["fired"] for r in told[:14])
    # before the window is full no frame votes, so no class can pass in the first two frames after it
    assert all(r["state"] == 0 for r in told[14:16]) and any(r["state"] for r in told)
    eager = gesture.recognise("points", gesture.features_of("points", points=pts), layers, [0.0] * 6, [1.0] * 6, thresholds=(0.2,) * 3, votes=(2,) * 3, warm_up=False).orderBy("frame_idx").collect()
    assert any(r["state"] for r in eager[:14])


def test_profile_peaks(spark):
    df = spark.createDataFrame([(1, 0, i, v) for i, v in enumerate([0.0, 5.0, 4.0, 0.0, 5.0, 1.0, None, 2.0])] + [(1, 1, 0, -1.0)], "recording_id long, frame_idx long, bin long, value double")
    assert values(tracking.peaks(df, 3, 2).select("frame_idx", "bin"), "frame_idx", "bin") == [(0, 1), (0, 4), (0, 7)]


def track(spark, frames, **k):
    spine = spark.createDataFrame([(1, i) for i in range(len(frames))], "recording_id long, frame_idx long")
    cand = spark.createDataFrame([(1, i, float(x)) for i, f in enumerate(frames) for x in f], "recording_id long, frame_idx long, range_m double")
    return tracking.track_maps(cand, spine, **k).orderBy("frame_idx", "target").collect()


def test_tracking_rejects_jumps_and_coasts(spark):
    r = track(spark, [[1.0], [1.2], [3.0], [], [1.3]], coast=1)
    assert [(x["range_m"], x["coasted"]) for x in r] == [(1.0, False), (1.2, False), (1.2, True), (None, False), (1.3, False)]


def test_targets_are_seeded_at_the_first_frame_only(spark):
    r = track(spark, [[1.0], [1.1, 3.0], [3.0]], targets=2)
    assert [x["range_m"] for x in r] == [1.0, None, 1.1, None, 1.1, None]
    assert [x["range_m"] for x in track(spark, [[], [1.0], [1.0]])] == [None, None, None]
    # a pair beyond the jump does not use up its track or its peak
    assert [x["range_m"] for x in track(spark, [[1.0, 2.0], [2.5, 2.7]], targets=2)] == [1.0, 2.0, 1.0, 2.5]


def test_optimal_assignment_beats_greedy(spark):
    frames = [[1.0, 1.4], [1.39, 1.9]]
    near = [x["range_m"] for x in track(spark, frames, targets=2)]
    best = [x["range_m"] for x in track(spark, frames, targets=2, optimal=True)]
    assert near == [1.0, 1.4, 1.0, 1.39] and best == [1.0, 1.4, 1.39, 1.9]


def follow(spark, frames, **k):
    """frames: the candidates of each frame, or None for none."""
    spine = spark.createDataFrame([(1, i) for i in range(len(frames))], "recording_id long, frame_idx long")
    rows = [(1, i, [float(x) for x in f]) for i, f in enumerate(frames) if f is not None]
    cand = spark.createDataFrame(rows, "recording_id long, frame_idx long, ranges array<double>")
    return [(r["range_m"], r["coasted"]) for r in tracking.track_points(cand, spine, **k).orderBy("frame_idx", "target").collect()]


def test_point_tracker_holds_its_range_and_deletes_only_with_candidates(spark):
    # held for one frame, then gone but alive while nothing is there, deleted by the next far candidate, seeded by the one after
    got = follow(spark, [[1.0], None, None, None, [5.0], [5.1], [5.2]], hold=1)
    assert got == [(1.0, False), (1.0, True), (None, False), (None, False), (None, False), (5.1, False), (5.2, False)]


def test_two_point_tracks_and_reseeding(spark):
    got = follow(spark, [[3.0, 1.0], [1.2], [1.3, 3.1], None, [9.0]], targets=2, hold=1)
    assert got == [(1.0, False), (3.0, False), (1.2, False), (3.0, True), (1.3, False), (3.1, False), (1.3, True), (3.1, True), (None, False), (None, False)]
    # a single candidate seeds the first track alone, and the second waits until none is alive
    assert follow(spark, [[2.0], [2.0, 4.0]], targets=2) == [(2.0, False), (None, False), (2.0, False), (None, False)]


def plain_tracker(frames, targets, jump, hold):
    """The tracker written out over arrays of candidates."""
    value = np.full((len(frames), targets), np.nan)
    last, misses = np.full(targets, np.nan), np.zeros(targets, int)
    for f, cand in enumerate(frames):
        cand = np.array([] if cand is None else cand, float)
        if len(cand) and np.isnan(last).all():
            seed = np.sort(cand)[:targets]
            last[: len(seed)] = value[f, : len(seed)] = seed
            misses[: len(seed)] = 0
            continue
        cost = np.abs(last[:, None] - cand[None, :])
        taken = set()
        while cost.size and (cost <= jump).any():
            k, j = np.unravel_index(np.nanargmin(np.where(np.isnan(cost), np.inf, cost)), cost.shape)
            value[f, k] = last[k] = cand[j]
            misses[k] = 0
            taken.add(k)
            cost[k, :], cost[:, j] = np.inf, np.inf
        for k in set(range(targets)) - taken:
            if not np.isnan(last[k]):
                misses[k] += 1
                if misses[k] <= hold:
                    value[f, k] = last[k]
                elif len(cand):
                    last[k], misses[k] = np.nan, 0
    return [None if np.isnan(x) else float(x) for x in value.ravel()]


@pytest.mark.parametrize("targets,hold", [(1, 2), (2, 1), (3, 0)])
def test_point_tracker_against_arrays(spark, targets, hold):
    rng = np.random.default_rng(targets)
    frames = [None if rng.random() < 0.3 else np.round(rng.uniform(0, 4, int(rng.integers(1, 4))), 2).tolist() for _ in range(150)]
    assert [v for v, _ in follow(spark, frames, targets=targets, hold=hold)] == plain_tracker(frames, targets, 0.6, hold)


def test_candidates_are_the_strongest_apart_from_each_other(spark):
    rows = [(0, 0, 1.0, 0.5, 10), (0, 0, 1.2, 0.5, 30), (0, 0, 3.0, 0.5, 20), (0, 0, 3.0, 0.0, 40), (1, 0, 2.0, 0.5, 5), (1, 0, 2.39, 0.5, 5), (1, 0, 2.5, 0.5, 1), (2, 0, 1.0, 0.0, 9)] + [(3, 0, 1 + k, 1, k) for k in range(20)]
    got = {r["frame_idx"]: r["ranges"] for r in tracking.strongest_candidates(cloud(spark, rows), 3, 0.15).collect()}
    assert got == {0: [1.2, 3.0], 1: [2.0, 2.5], 3: [20.0, 19.0, 18.0]}
    none = tracking.strongest_candidates(cloud(spark, [(0, 0, 2, 1, None), (0, 0, 1, 1, None)]), 1).first()
    assert none["ranges"] == [2.0]  # without side information all weigh the same, the first of them leads


def test_trackers_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(11)
    p = cloud(spark, [(f, rng.normal(), rng.uniform(0.5, 4), rng.choice([0.0, 0.5]), rng.uniform(0, 30)) for f in range(60) for _ in range(int(rng.integers(0, 6)))])
    spine = spark.createDataFrame([(1, i) for i in range(60)], "recording_id long, frame_idx long")

    def results():
        c = tracking.strongest_candidates(p, 2)
        ranges = c.select("recording_id", "frame_idx", F.explode("ranges").alias("range_m"))
        return [values(df, *df.columns[:3]) for df in (tracking.track_points(c, spine, 2), tracking.track_maps(ranges, spine, 2), tracking.separate_two(p))]

    want = results()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert results() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_fill_at_the_ends(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "recording_id long, frame_idx long, range_m double")
    assert [r["filled_m"] for r in tracking.fill_track(df).orderBy("frame_idx").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
    assert [r["filled_m"] for r in tracking.fill_track(df, "linear").orderBy("frame_idx").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    one = df.where("frame_idx < 3")
    assert [r["filled_m"] for r in tracking.fill_track(one).orderBy("frame_idx").collect()] == [None, 1.0, None]


def plain_two(frames, gate=0.75, apart=0.5, drop=10):
    """Two people written out frame by frame: seeding by clusters, nearest centre, forgetting."""
    centres, held, out = [None, None], [0, 0], []
    for xyz in frames:
        who = [-1] * len(xyz)
        if len(xyz) and None in [c if c is None else 0 for c in centres]:
            if len(xyz) >= 2:
                pair = max(((i, j) for i in range(len(xyz)) for j in range(len(xyz))), key=lambda p: (round(float(np.linalg.norm(xyz[p[0]] - xyz[p[1]])), 12), -p[0], -p[1]))
                c, old = [xyz[pair[0]], xyz[pair[1]]], None
                while True:
                    side = [bool(np.linalg.norm(x - c[0]) < np.linalg.norm(x - c[1])) for x in xyz]
                    if side == old or all(side) or not any(side):
                        break
                    c, old = [np.mean([x for x, s_ in zip(xyz, side) if s_], axis=0), np.mean([x for x, s_ in zip(xyz, side) if not s_], axis=0)], side
                if np.linalg.norm(c[0] - c[1]) > apart:
                    centres = c
        elif len(xyz):
            d = [[float(np.linalg.norm(x - c)) for x in xyz] for c in centres]
            for k in range(len(xyz)):
                if d[0][k] < d[1][k] and d[0][k] < gate:
                    who[k] = 0
                elif d[1][k] <= d[0][k] and d[1][k] < gate:
                    who[k] = 1
            for k in (0, 1):
                mine = [x for x, w in zip(xyz, who) if w == k]
                held[k] = 0 if mine else held[k] + 1
                if mine:
                    centres[k] = np.mean(mine, axis=0)
                if held[k] > drop:
                    centres[k] = None
        out += who
    return out


def test_two_people_are_told_apart(spark):
    rng = np.random.default_rng(8)
    rows, frames = [], []
    for f in range(120):
        people = [np.array([-1 + 0.01 * f, 2, 0.3]), np.array([1 - 0.005 * f, 2, -0.3])][: 1 if 30 <= f < 55 else 2]
        xyz = np.array([p + rng.normal(0, 0.08, 3) for p in people for _ in range(int(rng.integers(0, 4)))] + [rng.uniform(-4, 4, 3) for _ in range(int(rng.integers(0, 2)))]).reshape(-1, 3)
        frames.append(xyz)
        rows += [(1, f, i, 0.0, *map(float, x), 0.0, 0.0, 0.0) for i, x in enumerate(xyz)]
    got = [r["person"] for r in tracking.separate_two(spark.createDataFrame(rows, P)).orderBy("frame_idx", "point_idx").collect()]
    assert got == plain_two(frames) and {-1, 0, 1} == set(got)


def test_either_lost_person_seeds_both_anew(spark):
    near, far = (0, 0, 1, 0, 1), (0, 2, 1, 0, 1)
    frames = [[near, far], [near, far], [near], [near], [near, far], [near, far]]
    p = cloud(spark, [(f, *x[1:]) for f, xs in enumerate(frames) for x in xs])
    got = [r["person"] for r in tracking.separate_two(p, drop=1).orderBy("frame_idx", "point_idx").collect()]
    assert got == [-1, -1, 0, 1, 0, 0, -1, -1, 0, 1]


C = "recording_id long, frame_idx long, range_bin long, dop_bin long, value double"


def test_single_cell_moments(spark):
    one = spark.createDataFrame([(1, 0, 3, 20, 5000.0), (1, 0, 0, 21, 9.0), (1, 0, 3, 100, 0.0)], C)
    r = gesture.map_moments(one, 128, 1, 8, 2000).first()
    assert (r["doppler"], r["doppler_up"], r["doppler_down"], r["range_bins"], r["n_detections"], r["energy"]) == (20, 20, 0, 3, 1, 0.5)
    cells = spark.createDataFrame([(1, 0, 0, d, 1.0) for d in range(128)], C)
    assert gesture.suppress(cells, 128, 5).where("value = 0").count() == 11


def test_correlation_needs_twenty_frames(spark):
    df = spark.createDataFrame([(1, i, float(i), float(2 * i)) for i in range(25)] + [(2, i, 1.0, float(i)) for i in range(25)], "recording_id long, frame_idx long, azimuth double, doppler double")
    got = gesture.correlation(df).orderBy("recording_id", "frame_idx").collect()
    assert all(r["correlation"] == 0 for r in got[:19]) and all(r["correlation"] == pytest.approx(1) for r in got[19:25]) and all(r["correlation"] == 0 for r in got[25:])


def test_window_is_padded_at_the_start(spark):
    df = spark.createDataFrame([(1, i, float(i + 1)) for i in range(4)], "recording_id long, frame_idx long, a double")
    got = gesture.windows(df, ["a"], [0.0], [1.0], 3).orderBy("frame_idx").collect()
    assert [r["window"] for r in got] == [[0, 0, 1], [0, 1, 2], [1, 2, 3], [2, 3, 4]] and [r["ready"] for r in got] == [False, False, True, True]


def test_network_is_a_distribution(spark):
    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(4, 3)), np.zeros(4)), (rng.normal(size=(2, 4)), np.zeros(2))]
    df = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (1, 1, [1e3, -1e3, 0.0])], "recording_id long, frame_idx long, window array<double>")
    for r in gesture.score(df, layers).collect():
        h = np.maximum(np.array(r["window"]) @ layers[0][0].T, 0) @ layers[1][0].T
        assert np.allclose(r["probs"], np.exp(h - h.max()) / np.exp(h - h.max()).sum())


def test_debounce_needs_more_votes_than_the_count(spark):
    rows = [(1, i, [0.0, 1.0 if 2 <= i <= 6 else 0.0, 0.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "recording_id long, frame_idx long, probs array<double>")
    got = gesture.debounce(df, (0.9,) * 3, (3,) * 3, 5).orderBy("frame_idx").collect()
    assert [r["state"] for r in got] == [0, 0, 0, 0, 0, 1, 1, 1, 0] and [r["frame_idx"] for r in got if r["fired"]] == [5]
    assert values(gesture.event_counts(gesture.debounce(df, (0.9,) * 3, (3,) * 3, 5)), "state") == [(1, 1)]


def test_range_transform_of_a_tone(spark):
    x = np.cos(2 * np.pi * 2 * np.arange(8) / 8)
    df = spark.createDataFrame([(1, 0, np.tile(x, 4).tolist())], "recording_id long, frame_idx long, adc array<double>")
    cube = rawadc.Cube(4, 1, 8)
    v = [r["value"] for r in rawadc.range_time(df, cube, 0, 16).orderBy("bin").collect()]
    assert int(np.argmax(v[:9])) == 4 and len(v) == 16
    vt = [r["value"] for r in rawadc.velocity_time(df, cube, 0, 16).orderBy("bin").collect()]
    assert int(np.argmax(vt)) == 2


def hann(n):
    return np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / n) for k in range(n)])


def test_cubes_of_several_receivers_and_another_background(spark):
    """All four maps against transforms written out, for complex samples, three receivers and 1024 range bins."""
    rng = np.random.default_rng(6)
    shape, cube = (6, 3, 20), rawadc.Cube(6, 3, 20)
    walk = rng.normal(size=(5, *shape)) + 1j * rng.normal(size=(5, *shape))
    room = rng.normal(size=(4, *shape)) + 1j * rng.normal(size=(4, *shape)) + 3
    schema = "recording_id long, frame_idx long, adc array<double>, adc_im array<double>"
    table = lambda rec, x: spark.createDataFrame([(rec, 7 + f, y.real.ravel().tolist(), y.imag.ravel().tolist()) for f, y in enumerate(x)], schema).repartition(3)
    other = spark.createDataFrame([(1, 9), (2, 8)], "recording_id long, background_id long")
    frames = table(1, walk).unionByName(table(2, walk))
    clean = rawadc.remove_background(frames, table(9, room).unionByName(table(1, walk)), other, cube)
    want = walk[:4] - room.mean(axis=0)  # four frames are in both
    got = {r["frame_idx"] - 7: np.array(r["adc"]) + 1j * np.array(r["adc_im"]) for r in clean.where("recording_id = 1").collect()}
    assert sorted(got) == [0, 1, 2, 3] and clean.where("recording_id = 2").count() == 0
    assert all(np.allclose(got[f].reshape(shape), want[f]) for f in got)
    x = np.fft.fft(want[:, :, 2] * hann(20), 1024, axis=2)
    grid = lambda df, n: np.array([r["value"] for r in df.orderBy("frame_idx", "bin").collect()]).reshape(-1, n)
    one = clean.where("recording_id = 1")
    assert np.allclose(grid(rawadc.range_time(one, cube, 2), 1024), np.abs(x).mean(axis=1))
    at = np.abs(x[:, :, 100:301]).mean(axis=1).argmax(axis=1) + 100
    doppler = lambda z: np.abs(np.fft.fftshift(np.fft.fft(z * hann(6), 16, axis=1), axes=1))
    assert np.allclose(grid(rawadc.velocity_time(one, cube, 2, first=100, last=300, dopplers=16), 16), doppler(x[np.arange(4), :, at]))
    tracks = spark.createDataFrame([(1, 7, 4.0), (1, 8, 0.02), (1, 9, None), (1, 10, 100.0)], "recording_id long, frame_idx long, range_m double")
    follow = grid(rawadc.velocity_time_following(one, tracks, cube, 0.05, 2, dopplers=16), 16)
    bands = [(0, 75, 86), (1, 0, 6), (3, 1018, 1024)]
    assert np.allclose(follow, np.concatenate([doppler(x[f : f + 1, :, a:b].sum(axis=2)) for f, a, b in bands]))


def test_frames_of_another_size_are_an_error(spark):
    df = spark.createDataFrame([(1, 0, [1.0] * 7)], "recording_id long, frame_idx long, adc array<double>")
    with pytest.raises(Exception, match="does not hold"):
        rawadc.range_time(df, rawadc.Cube(2, 2, 2), 0, 8).collect()


def test_audit_of_a_lossy_recording(spark):
    s = "recording_id long, frame_idx long, frame_number long, num_obj long, num_points long, total_len long, skipped_before long, tlv_order string, anomaly string"
    df = spark.createDataFrame([(1, 0, 10, 1, 1, 64, 0, "1,7", None), (1, 1, 13, 0, 0, 32, 7, "2,6", "bad (1)"), (1, 2, 14, 2, 1, 64, 0, "1,7", "bad (2)")], s)
    r = audit.summary(df).first()
    assert (r["frames_lost"], r["bytes_skipped"], r["resyncs"], r["zero_point_frames"], r["count_mismatches"], r["frames_without_side_info"]) == (2, 7, 1, 1, 1, 1)
    assert r["verdict"].startswith("not complete") and values(audit.anomaly_counts(df).select("anomaly", "n"), "n") == [("bad", 2)]
    e = audit.early_stop(df).first()
    assert (e["first_empty"], e["frames_lost"], e["second_not_side_info"]) == (1, 2, 0)
    orders = ["1,7,2", "1,2", "2,7", "2,6", "1", "1,3,7", "7,1"]
    assert audit.early_stop(spark.createDataFrame([(1, i, i, 1, 1, 64, 0, o, None) for i, o in enumerate(orders)], s)).first()["second_not_side_info"] == 2


def test_tiers_by_payload(spark):
    s = "recording_id long, frame_idx long, num_points long, tlv_order string"
    rows = [(1, 0, 3, "1,7"), (2, 0, 0, "2,6"), (3, 0, 2, "1"), (3, 1, 0, "1,8"), (4, 0, 1, "1,4"), (5, 0, 1, "5,2"), (6, 0, 0, "3,9"), (7, 0, 0, "15,28")]
    got = {r["recording_id"]: r for r in audit.availability(spark.createDataFrame(rows, s)).collect()}
    assert {k: r["tier"] for k, r in got.items()} == {1: "C", 2: "C+", 3: "B", 4: "B", 5: "B", 6: "C", 7: "C"}
    on = {k: {c for c, v in r.asDict().items() if v is True} for k, r in got.items()}
    assert on == {1: {"has_points", "has_side"}, 2: {"has_profile", "has_stats"}, 3: {"has_points", "has_angle"}, 4: {"has_points", "has_angle"}, 5: {"has_points", "has_map", "has_profile"}, 6: {"has_noise", "has_temperature"}, 7: set()}


def packet(frame, pts, odd=b"", kinds=None, length=None):
    side = b"".join(struct.pack("<hh", -15, 200) for _ in pts)
    parts = kinds or [(1, b"".join(struct.pack("<4f", *p) for p in pts)), (7, side)]
    body = b"".join(struct.pack("<II", k, len(d)) + d for k, d in parts) + odd
    n = length or -(-(40 + len(body)) // 32) * 32
    return (wire.MAGIC + struct.pack("<8I", 0x03060000, n, 0xA6843, frame, 0, len(pts), len(parts), 0) + body).ljust(n, b"\x0f")


@pytest.fixture(scope="module")
def stream():
    inside = struct.unpack("<2f", wire.MAGIC)
    ps = [packet(0, [(1, 2, 3, 4)]), packet(1, []), packet(2, [(*inside, 0, 0)] * 2), packet(3, [(1, 1, 1, 1)], kinds=[(99, b"abc"), (7, struct.pack("<hh", 1, 2)), (1, struct.pack("<4f", 1, 1, 1, 1))])]
    return ps[0][-20:] + ps[0] + ps[1] + ps[2][: len(ps[2]) // 2] + ps[2] + wire.MAGIC + b"\xff" * 10 + ps[3] + ps[1][:30]


def test_cutting_a_damaged_capture(spark, stream):
    rows = captures.cut(captures.slices(spark.createDataFrame([(1, stream), (2, b""), (3, None)], "recording_id long, content binary"), 100)).orderBy("frame_idx").collect()
    assert [struct.unpack_from("<I", bytes(r["packet"]), 20)[0] for r in rows][:2] == [0, 1] and rows[0]["skipped_before"] == 20
    total = sum(r["skipped_before"] + len(r["packet"]) for r in rows)
    assert total <= len(stream) and rows[-1]["byte_offset"] + len(rows[-1]["packet"]) == len(stream) - 30


def test_shredding_by_type(spark, stream):
    d = captures.decode(captures.shred(captures.header(captures.cut(captures.slices(spark.createDataFrame([(1, stream)], "recording_id long, content binary"))))))
    rows = {r["frame_number"]: r for r in d.collect()}
    assert rows[0]["points"][0]["v"] == 4 and rows[0]["side"][0]["snr_db"] == -1.5 and rows[0]["sdk"] == "3.6.0.0" and rows[0]["device"] == "xWR6843"
    assert rows[1]["points"] == [] and rows[3]["anomalies"] == ["unknown_tlv_type (99, 3 bytes)"] and len(rows[3]["points"]) == 1


def test_reassembly_does_not_depend_on_the_cuts(spark, stream, tmp_path):
    want = [(1, i, at, gap, n) for i, (at, n, gap) in enumerate(wire.chain(stream))]
    for size in (7, 50, 1000):
        parts = [(1, k, stream[i : i + size]) for k, i in enumerate(range(0, len(stream), size))]
        folder = tmp_path / f"chunks{size}"
        step = max(1, len(parts) // 4)
        for j in range(0, len(parts), step):
            spark.createDataFrame(parts[j : j + step], "recording_id long, seq long, bytes binary").coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema("recording_id long, seq long, bytes binary").option("maxFilesPerTrigger", 1).parquet(str(folder))
        got = stateful.replay(stateful.reassemble(source), str(tmp_path / f"out{size}"))
        assert values(got.select("recording_id", "frame_idx", "byte_offset", "skipped_before", "length"), "frame_idx") == want
        assert all(bytes(r["packet"]) == stream[r["byte_offset"] : r["byte_offset"] + r["length"]] for r in got.collect())


def nested():
    """A packet whose payload holds a whole plausible packet, between two plain ones; the last is cut off."""
    inner = made.pack(77, 0, [])
    big = made.pack(5, 0, [(9999, b"x" * 24 + inner + b"y" * 60)])
    return made.pack(4, 0, []) + big + made.pack(6, 0, [(1, bytes(32))]) + big[:150]


def test_a_packet_inside_a_packet_is_not_found(spark):
    data = nested()
    whole = list(wire.chain(data))
    assert [n for _, n, _ in whole] == [64, 224, 96] and all(gap == 0 for _, _, gap in whole)
    for cut in range(len(data)):
        assert list(wire.chain(data[:cut])) == [w for w in whole if w[0] + w[1] <= cut]


@pytest.mark.parametrize("size", [1, 40, 64, 100, 1000])
def test_nested_packets_at_every_chunk_size(spark, tmp_path, size):
    data = nested()
    chunks = [(1, i, data[at : at + size]) for i, at in enumerate(range(0, len(data), size))]
    spark.createDataFrame(chunks, "recording_id long, seq long, bytes binary").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("recording_id long, seq long, bytes binary").parquet(str(tmp_path / "in"))
    got = stateful.replay(stateful.reassemble(source), str(tmp_path / "out")).orderBy("frame_idx").collect()
    assert [(r["byte_offset"], r["length"], r["skipped_before"]) for r in got] == list(wire.chain(data))


def accounted(data, size=10**9):
    fold = apps.accounts()
    state = fold.start()
    for seq, at in enumerate(range(0, len(data), size)):
        state, _ = fold.step(state, (seq, data[at : at + size]))
    return dict(zip(apps.ACCOUNT, fold.finish(state)[0]))


def test_where_the_bytes_of_a_capture_went(stream):
    a = accounted(b"abc" + wire.MAGIC + bytes(40) + nested())
    assert a == {"bytes_total": 51 + 534, "bytes_in_frames": 384, "bytes_skipped": 51, "truncated_tail": 150, "leading_partial": 3, "resyncs": 1, "false_magics": 1, "padded_frames": 3, "padding_bytes": 24 + 28 + 16, "anomalous_frames": 1}
    assert accounted(b"") == dict.fromkeys(apps.ACCOUNT, 0)
    assert accounted(b"no packet")["bytes_skipped"] == 9
    for data in (stream, stream[13:], stream[:-40], nested(), b"x" * 5 + wire.MAGIC[:6], wire.MAGIC + b"\xff" * 40 + wire.MAGIC):
        c = accounted(data)
        assert c["bytes_in_frames"] + c["bytes_skipped"] + c["truncated_tail"] == c["bytes_total"] == len(data)
        assert all(accounted(data, size) == c for size in (1, 7, 40, 64, 333))


def test_odd_payload_lengths():
    one = lambda body, n=None, count=1: wire.MAGIC + struct.pack("<8I", 0, n or 40 + len(body), 0, 0, 0, 0, count, 0) + body
    # a length that overruns and is too short to hold its own header
    assert wire.directory(one(struct.pack("<II", 1, 5))) == ([], ["tlv_payload_overruns_frame (type 1 len 5)", "tlv_count_mismatch (header says 1, parsed 0)", "trailing_bytes_in_frame (8)"], 0)
    # one that includes its header
    assert wire.directory(one(struct.pack("<II", 1, 12) + bytes(4))) == ([(1, 48, 4)], ["tlv_length_includes_header (type 1)"], 0)
    # fewer payloads than the header says, and a header that does not fit
    assert wire.directory(one(struct.pack("<II", 2, 0) + b"abc", count=2)) == ([(2, 48, 0)], ["tlv_header_overruns_frame (tlv 1 of 2)", "tlv_count_mismatch (header says 2, parsed 1)", "trailing_bytes_in_frame (3)"], 0)
    # less than a segment left over is padding only in packets of whole segments
    assert wire.directory(one(struct.pack("<II", 2, 0) + bytes(16), 64)) == ([(2, 48, 0)], [], 16)
    assert wire.directory(one(struct.pack("<II", 2, 0) + bytes(12))) == ([(2, 48, 0)], ["trailing_bytes_in_frame (12)"], 0)
    assert wire.directory(one(struct.pack("<II", 2, 0) + bytes(48), 96)) == ([(2, 48, 0)], ["trailing_bytes_in_frame (48)"], 0)


def test_short_and_odd_payloads(spark):
    payloads = [(5, bytes(6)), (6, bytes(10)), (9, bytes(28)), (1050, bytes(12)), (1, bytes(20)), (12, b"?")]
    rows = spark.createDataFrame([(1, made.pack(0, 0, payloads)), (2, made.pack(1, 0, []))], "recording_id long, packet binary")
    d = captures.decode(captures.shred(rows), (5, 6, 9, 1050, 1), {5: 4}).orderBy("recording_id").collect()
    assert d[0]["range_doppler"] == [0, 0, 0] and d[0]["stats"] is None and d[0]["temperature"]["dig1"] == 0 and len(d[0]["points"]) == 1
    assert d[0]["anomalies"] == ["unknown_tlv_type (12, 1 bytes)", "range_doppler_size_mismatch (expected 4, got 3)", "stats_too_short (10)", "gesture_features_size_mismatch (expected 10, got 3)"]
    assert d[1]["range_doppler"] is None and d[1]["points"] is None and d[1]["anomalies"] == []


def test_maps_of_full_size(spark):
    rd = [float(i % 97) for i in range(128 * 64)]
    frames = spark.createDataFrame([(1, 0, rd)], "recording_id long, frame_idx long, rd array<double>")
    x = np.array(rd).reshape(128, 64)
    assert [r["value"] for r in maps.range_time_dense(frames, 128, 64).orderBy("bin").collect()] == x.sum(axis=1).tolist()
    assert [r["value"] for r in maps.velocity_time_dense(frames, 128, 64, 3, 90).orderBy("bin").collect()] == x[3:91].sum(axis=0).tolist()


def test_cadence_of_a_long_recording(spark):
    s = spark.range(80_000).selectExpr("1L as recording_id", "id as frame_idx", "id * 0.04 as t", "1 + sin(2 * pi() * 1.5 * id * 0.04) as v")
    r = gait.spectral_cadence(s, 0.04).first()
    assert r["cadence_spectral"] == pytest.approx(90) and r["confidence"] > 0.4


def test_classes_are_balanced_by_repeating_rows(spark):
    rows = spark.createDataFrame([(i, 0, [float(i % 7), 1.0], 0 if i % 10 else 1) for i in range(400)], "recording_id long, frame_idx long, window array<double>, target int")
    model = gesture.train(rows, hidden=(4,), classes=2, rounds=3)
    assert model.numFeatures == 2


def test_sessions_are_read_by_label(spark, tmp_path):
    f = spark.createDataFrame([(1, 5, "a", 2.0, 3.0), (1, 6, "a", 2.5, 4.0), (2, 0, "b", 9.0, 5.0)], "recording_id long, frame_idx long, label string, t double, f0 double")
    path = captures.write_sessions(f, "label", str(tmp_path / "s"))
    got = captures.read_sessions(spark, path, f.drop("t").schema, "label", ["a"])
    assert sorted((r["frame_idx"], r["t"], r["f0"]) for r in got.collect()) == [(5, 0.0, 3.0), (6, 0.5, 4.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_streamed_decisions_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(r, i, rng.dirichlet([0.5] * 4).tolist()) for i in range(60) for r in (1, 2)]
    schema = "recording_id long, frame_idx long, probs array<double>"
    for j in range(0, 120, 40):
        spark.createDataFrame(rows[j : j + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "probs"))
    limits, votes = (0.5,) * 4, (2,) * 4
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "probs"))
    got = values(stateful.replay(stateful.online_decisions(source, limits, votes), str(tmp_path)), "recording_id", "frame_idx")
    batch = gesture.debounce(spark.createDataFrame(rows, schema), limits, votes).select("recording_id", "frame_idx", "state", "fired")
    assert got == values(batch, "recording_id", "frame_idx") and any(r[3] for r in got)


def test_runs_and_configs(spark):
    files = spark.createDataFrame([("/d/a", "x.dat", 1), ("/d/a", "x.cfg", 1), ("/d/b", "y.dat", 2), ("/d/empty", "z.dat", 2), ("/d/empty", "z.cfg", 2), ("/d/c", "p.dat", 0), ("/d/c", "q.dat", 0)], "dir string, name string, modified_at long")
    runs = captures.find_runs(files, ["fallback.cfg"])
    assert values(runs.select("dir", "cfg", "cfg_is_fallback"), "dir") == [("/d/a", "x.cfg", False), ("/d/b", "fallback.cfg", True), ("/d/empty", "z.cfg", False)]
    assert captures.latest(files).first()["dir"] == "/d/empty"
    assert values(captures.background_runs(runs), "dir") == [("/d/a", "/d/empty"), ("/d/b", "/d/empty")]
    rooms = [("/empty/run1", "a.cfg", False), ("/empty/run2", "f.cfg", True), ("/empty/an_Empty_room", "f.cfg", True), ("/empty/old_empty", "c.cfg", False)]
    sites = spark.createDataFrame(rows := rooms, "dir string, cfg string, cfg_is_fallback boolean")
    # the name of the folder above does not count, nor does a room without a configuration of its own
    assert {r["background"] for r in captures.background_runs(sites).collect()} == {"/empty/old_empty"} and len(rows) == 4
    two = files.unionByName(spark.createDataFrame([("/d/a", "w.cfg", 1)], files.schema))
    with pytest.raises(Exception, match="more than one"):
        captures.find_runs(two, ["f"]).collect()
