"""Queries M, C and H with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dopplerlake.functions.scalars import rounded
from dopplerlake.operators import ghosts as h
from dopplerlake.operators import maps as m
from dopplerlake.operators import points as p
from dopplerlake.plans.points import AZIMUTH, RANGE, _tracks
from dopplerlake.sources import fixtures as fx
from dopplerlake.sources.fixtures import sql


def _profile(s, d):
    return m.range_time_profile(fx.profile_cells(s, d))


def _payloads(s, d):
    k = F.col("recording_id") % 3
    return fx.table(s, d, "embeddings").select(F.col("label").cast("long").alias("recording_id")).distinct().select("recording_id", (k == 0).alias("has_map"), (k < 2).alias("has_profile"))


def _noise(s, d):
    return fx.profile_cells(s, d).withColumn("noise_db", F.lit(-40.0) + F.col("range_bin") * 0.1)


def _features(s, d):
    return h.features(fx.points(s, d, by=("recording_id",)), 0.25, 0.5)


def _configs(s, d):
    k = F.col("p_partkey")
    return fx.table(s, d, "part").select(k.alias("cfg_id"), (0.1 + k % 25 * 0.01).alias("velocity_spacing"), F.lit(64).alias("velocity_bins"), (k % 8 + 57).alias("chirps"))


QUERIES = {
    "rt_sparse": lambda s, d: m.sparse_range_time(fx.points(s, d), 0.25, 64),
    "m01_range_time_dense": lambda s, d: m.range_time_dense(fx.rd_frames(s, d), 8, 8),
    "m02_range_time_profile": _profile,
    "m04_sparse_masked": lambda s, d: m.sparse_range_time(p.keep(fx.points(s, d), h.labels(_features(s, d), 0.5, ["method1"])), 0.25, 64),
    "m05_velocity_time_dense": lambda s, d: m.velocity_time_dense(fx.rd_frames(s, d), 8, 8, 2, 5),
    "m06_velocity_time_sparse": lambda s, d: m.sparse_velocity_time(fx.points(s, d), 0.5, 16, 0.5, 4.0),
    "m07_velocity_time_following": lambda s, d: m.following_velocity_time(fx.points(s, d), _tracks(s, d), 0.5, 16),
    "m08_gate_range": lambda s, d: m.gate_range(m.sparse_range_time(fx.points(s, d), 0.25, 64), 0.25, 1.0, 3.0),
    "m09_decibels": lambda s, d: m.decibels(m.range_time_dense(fx.rd_frames(s, d), 8, 8)),
    "m10_display_limits": lambda s, d: m.display_limits(m.decibels(m.range_time_dense(fx.rd_frames(s, d), 8, 8))),
    "m11_best_source": lambda s, d: m.best_source(m.range_time_dense(fx.rd_frames(s, d), 8, 8), _profile(s, d), m.sparse_range_time(fx.points(s, d), 0.25, 64), _payloads(s, d)),
    "m12_profile_scaled": lambda s, d: m.profile_scaled(fx.dense_frames(s, d).withColumn("raw", F.transform("values", lambda v: F.floor(F.abs(v) * 1000).cast("double"))), 0.01),
    "m14_true_resolution": lambda s, d: m.true_resolution(_configs(s, d)).select("cfg_id", "velocity_resolution"),
    "m15_shift_doppler": lambda s, d: m.shift_doppler(fx.rd_frames(s, d), 8).select(*m.FRAME, F.posexplode("rd").alias("pos", "value")),
    "m16_frame_pair": lambda s, d: m.frame_pair(fx.rd_frames(s, d), 3, 8, 8),
    "m17_mean_profiles": lambda s, d: m.mean_profiles(_noise(s, d), 15.0),
    "c01_notch_map": lambda s, d: m.range_time_dense(m.notch_map(fx.rd_frames(s, d), 8, 1), 8, 8),
    "c02_baseline_median": lambda s, d: m.subtract_baseline(_profile(s, d), "median", False),
    "c02_baseline_mean": lambda s, d: m.subtract_baseline(m.range_time_dense(fx.rd_frames(s, d), 8, 8), "mean"),
    "c02_baseline_percentile": lambda s, d: m.subtract_baseline(m.range_time_dense(fx.rd_frames(s, d), 8, 8), "percentile"),
    "c03_empty_scene": lambda s, d: m.subtract_empty_scene(fx.rd_cells(s, d), fx.rd_cells(s, d).where("frame_idx % 2 = 1")),
    "h01_features": lambda s, d: _features(s, d).select(*h.FRAME, "point_idx", "range_bin", "doppler_bin", "cocell", "secondary", "d_range", "d_azimuth", "d_v"),
    "h03_snr_excess": lambda s, d: _features(s, d).select(*h.FRAME, "point_idx", "excess_db"),
    "h05_labels": lambda s, d: h.labels(_features(s, d), 0.5),
    "h11_agreement": lambda s, d: h.agreement(h.widen(_features(s, d), 0.5), list(h.METHODS)),
    "h13_tagged": lambda s, d: h.tagged(h.labels(_features(s, d), 0.5)),
}
QUERIES = {k: (lambda s, d, f=f: rounded(f(s, d))) for k, f in QUERIES.items()}

W = "coalesce(pow(10, snr_db / 20), 1)"
BIN = f"CAST(least(greatest(round_even({RANGE} / 0.25e0, 0), 0), 63) AS BIGINT)"
VBIN = "CAST(least(greatest(round_even(v / 0.5e0, 0) + 8, 0), 15) AS BIGINT)"
RT = f"SELECT recording_id, frame_idx, {BIN} AS bin, sum({W}) AS value FROM points GROUP BY 1, 2, 3"
DENSE = "SELECT recording_id, frame_idx, range_bin AS bin, sum(value) AS value FROM rd_cells GROUP BY 1, 2, 3"
PROFILE = "SELECT recording_id, frame_idx, range_bin AS bin, value_db AS value FROM profile_cells"
TRACKS = f"SELECT recording_id, frame_idx, {RANGE} AS range_m FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, frame_idx ORDER BY snr_db DESC NULLS LAST, point_idx) AS k FROM points) WHERE k = 1 AND snr_db >= 25"


def _out(source: str, value: str = "value") -> str:
    return f"SELECT recording_id, frame_idx, bin, round({value}, 6) + 0.0 AS value FROM ({source})"


FEATURES = """, f0 AS (SELECT *, $RANGE AS range_m, $AZIMUTH AS azimuth_deg FROM points),
f1 AS (SELECT *, CAST(round_even(range_m / 0.25e0, 0) AS BIGINT) AS range_bin, CAST(round_even(v / 0.5e0, 0) AS BIGINT) AS doppler_bin FROM f0),
f2 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY recording_id, frame_idx, range_bin, doppler_bin) AS cocell,
  row_number() OVER (PARTITION BY recording_id, frame_idx, range_bin, doppler_bin ORDER BY snr_db DESC NULLS LAST, point_idx) > 1 AS secondary,
  min(range_m) FILTER (snr_db IS NOT NULL) OVER r AS lo, max(range_m) FILTER (snr_db IS NOT NULL) OVER r AS hi FROM f1 WINDOW r AS (PARTITION BY recording_id)),
f3 AS MATERIALIZED (SELECT *, CASE WHEN hi > lo THEN least(greatest(floor((range_m - lo) / ((hi - lo) / 16)), 0), 15) END AS b FROM f2),
whole AS (SELECT recording_id, median(snr_db) AS overall FROM f3 WHERE snr_db IS NOT NULL GROUP BY 1),
knots AS (SELECT recording_id, list({'x': lo + (b + 0.5) * (hi - lo) / 16, 'm': m} ORDER BY b) AS k FROM (SELECT recording_id, b, median(snr_db) AS m, min(lo) AS lo, min(hi) AS hi FROM f3 WHERE snr_db IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
f4a AS (SELECT f3.*, overall, k, list_filter(k, lambda kn: kn.x <= range_m)[-1] AS k0, list_filter(k, lambda kn: kn.x > range_m)[1] AS k1 FROM f3 LEFT JOIN whole USING (recording_id) LEFT JOIN knots USING (recording_id)),
f4 AS (SELECT * EXCLUDE (k, k0, k1), CASE WHEN coalesce(len(k), 0) < 2 THEN overall WHEN k0 IS NULL THEN k1.m WHEN k1 IS NULL THEN k0.m ELSE k0.m + (k1.m - k0.m) * (range_m - k0.x) / (k1.x - k0.x) END AS level FROM f4a),
q AS (SELECT recording_id, frame_idx, quantile_cont(snr_db, 0.75) AS q, count(*) AS c FROM points GROUP BY 1, 2),
f5 AS MATERIALIZED (SELECT f4.*, coalesce(snr_db - level, 0) AS excess_db, CASE WHEN c > 2 AND q IS NOT NULL THEN coalesce(snr_db >= q, false) ELSE true END AS eligible FROM f4 JOIN q USING (recording_id, frame_idx)),
pr AS (SELECT recording_id, frame_idx, range_m AS pr, azimuth_deg AS pa, v AS pv FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, frame_idx ORDER BY range_m, point_idx) AS k FROM f5 WHERE eligible) WHERE k = 1),
feat AS MATERIALIZED (SELECT f5.*, range_m - pr AS d_range, azimuth_deg - pa AS d_azimuth, v - pv AS d_v FROM f5 JOIN pr USING (recording_id, frame_idx)),
g AS (SELECT *, abs(doppler_bin) <= 1 AS g1, secondary AS g2, excess_db <= -3 AND d_range >= 0.5 AS g3, d_range BETWEEN 0.5 AND 6 AND abs(d_v) <= 1.5 AND abs(v) >= 0.15 AND abs(d_azimuth) >= 8 AS g4 FROM feat),
sc AS (SELECT *, CASE WHEN g2 THEN least(cocell / 3, 1.0) ELSE 0 END AS s2, CASE WHEN g3 THEN least(greatest(-excess_db / 12, 0), 1) ELSE 0 END AS s3, CASE WHEN g4 THEN 1 - abs(d_v) / 1.5 ELSE 0 END AS s4 FROM g),
lab AS (SELECT recording_id, frame_idx, point_idx, unnest(['method0', 'method1', 'method2', 'method3', 'method4', 'method5']) AS method,
  unnest([0.0e0, CASE WHEN g1 THEN 1.0e0 ELSE 0 END, s2, s3, s4, (s2 + s3 + s4) / 3]) AS score, unnest([false, g1, g2, g3, g4, CAST(g2 AS INT) + CAST(g3 AS INT) + CAST(g4 AS INT) >= 2]) AS is_ghost FROM sc)
""".replace("$RANGE", RANGE).replace("$AZIMUTH", AZIMUTH)
SQL = {
    "rt_sparse": sql(_out(RT), "points"),
    "m01_range_time_dense": sql(_out(DENSE), "rd_cells"),
    "m02_range_time_profile": sql(_out(PROFILE), "profile_cells"),
    "m04_sparse_masked": sql(_out(RT + " HAVING false UNION ALL " + RT.replace("FROM points", "FROM points WHERE abs(round_even(v / 0.5e0, 0)) > 1")), "points"),
    "m05_velocity_time_dense": sql(_out("SELECT recording_id, frame_idx, dop_bin AS bin, sum(value) AS value FROM rd_cells WHERE range_bin BETWEEN 2 AND 5 GROUP BY 1, 2, 3"), "rd_cells"),
    "m06_velocity_time_sparse": sql(_out(f"SELECT recording_id, frame_idx, {VBIN} AS bin, sum({W}) AS value FROM points WHERE {RANGE} BETWEEN 0.5 AND 4 GROUP BY 1, 2, 3"), "points"),
    "m07_velocity_time_following": sql(_out(f"SELECT recording_id, frame_idx, {VBIN} AS bin, sum({W}) AS value FROM points JOIN ({TRACKS}) USING (recording_id, frame_idx) WHERE abs({RANGE} - range_m) <= 0.25 GROUP BY 1, 2, 3"), "points"),
    "m08_gate_range": sql(_out(RT) + " WHERE bin * 0.25 BETWEEN 1 AND 3", "points"),
    "m09_decibels": sql(_out(DENSE, "greatest(20 * log10(greatest(value, 1e-12)), -120)"), "rd_cells"),
    "m10_display_limits": sql(f"SELECT recording_id, round(quantile_cont(db, 0.35), 6) AS low, round(quantile_cont(db, 0.995), 6) AS high FROM (SELECT recording_id, greatest(20 * log10(greatest(value, 1e-12)), -120) AS db FROM ({DENSE})) GROUP BY 1", "rd_cells"),
    "m11_best_source": sql(f""", e AS (SELECT DISTINCT CAST(label AS BIGINT) AS recording_id FROM embeddings),
    a AS (SELECT *, 'rd' AS source FROM ({DENSE}) WHERE recording_id % 3 = 0 UNION ALL SELECT *, 'profile' FROM ({PROFILE}) WHERE recording_id % 3 = 1 UNION ALL SELECT *, 'points' FROM ({RT}) WHERE recording_id % 3 = 2)
    SELECT recording_id, frame_idx, bin, round(value, 6) + 0.0 AS value, source FROM a WHERE recording_id IN (SELECT recording_id FROM e)""", "points", "rd_cells", "profile_cells"),
    "m12_profile_scaled": sql("SELECT recording_id, frame_idx, pos AS bin, round(floor(abs(val) * 1000) * 0.01e0 * (20 * 0.30102999566398120e0), 6) + 0.0 AS db, round(pow(2.0e0, floor(abs(val) * 1000) * 0.01e0), 6) AS linear FROM emb_cells", "emb_cells"),
    "m14_true_resolution": "SELECT p_partkey AS cfg_id, round((0.1e0 + p_partkey % 25 * 0.01e0) * 64 / (p_partkey % 8 + 57), 6) AS velocity_resolution FROM part",
    "m15_shift_doppler": sql("SELECT recording_id, frame_idx, CAST(range_bin * 8 + (dop_bin + 4) % 8 AS INT) AS pos, round(value, 6) + 0.0 AS value FROM rd_cells", "rd_cells"),
    "m16_frame_pair": sql("SELECT recording_id, frame_idx, bin, round(value, 6) AS value, map FROM (SELECT recording_id, frame_idx, range_bin AS bin, sum(value) AS value, 'RT' AS map FROM rd_cells GROUP BY 1, 2, 3 UNION ALL SELECT recording_id, frame_idx, dop_bin, sum(value), 'VT' FROM rd_cells GROUP BY 1, 2, 3) WHERE frame_idx = 3", "rd_cells"),
    "m17_mean_profiles": sql("SELECT recording_id, range_bin, round(avg(value_db), 6) AS signal_db, round(avg(-40.0e0 + range_bin * 0.1e0), 6) AS noise_db, round(avg(value_db) - avg(-40.0e0 + range_bin * 0.1e0), 6) AS margin_db, avg(value_db) - avg(-40.0e0 + range_bin * 0.1e0) > 15 AS passes FROM profile_cells GROUP BY 1, 2", "profile_cells"),
    "c01_notch_map": sql(_out("SELECT recording_id, frame_idx, range_bin AS bin, sum(CASE WHEN abs(dop_bin - 4) <= 1 THEN 0 ELSE value END) AS value FROM rd_cells GROUP BY 1, 2, 3"), "rd_cells"),
    "c02_baseline_median": sql(_out(f"SELECT *, value - median(value) OVER (PARTITION BY recording_id, bin) AS x FROM ({PROFILE})", "x"), "profile_cells"),
    "c02_baseline_mean": sql(_out(f"SELECT *, greatest(value - avg(value) OVER (PARTITION BY recording_id, bin), 0) AS x FROM ({DENSE})", "x"), "rd_cells"),
    "c02_baseline_percentile": sql(_out(f"SELECT *, greatest(value - quantile_cont(value, 0.2) OVER (PARTITION BY recording_id, bin), 0) AS x FROM ({DENSE})", "x"), "rd_cells"),
    "c03_empty_scene": sql("SELECT recording_id, frame_idx, range_bin, dop_bin, round(greatest(value - avg(value) FILTER (frame_idx % 2 = 1) OVER (PARTITION BY recording_id, range_bin, dop_bin), 0), 6) + 0.0 AS value FROM rd_cells", "rd_cells"),
    "h01_features": sql(FEATURES + "SELECT recording_id, frame_idx, point_idx, range_bin, doppler_bin, cocell, secondary, round(d_range, 6) + 0.0 AS d_range, round(d_azimuth, 6) + 0.0 AS d_azimuth, round(d_v, 6) + 0.0 AS d_v FROM feat", "points"),
    "h03_snr_excess": sql(FEATURES + "SELECT recording_id, frame_idx, point_idx, round(excess_db, 6) + 0.0 AS excess_db FROM feat", "points"),
    "h05_labels": sql(FEATURES + "SELECT recording_id, frame_idx, point_idx, method, round(score, 6) + 0.0 AS score, is_ghost FROM lab", "points"),
    "h11_agreement": sql(FEATURES + """SELECT x.recording_id, x.method AS a, y.method AS b, count(*) FILTER (x.is_ghost AND y.is_ghost) AS both, count(*) FILTER (x.is_ghost OR y.is_ghost) AS either,
    round(CASE WHEN count(*) FILTER (x.is_ghost OR y.is_ghost) > 0 THEN count(*) FILTER (x.is_ghost AND y.is_ghost) / count(*) FILTER (x.is_ghost OR y.is_ghost) END, 6) AS jaccard
    FROM lab x JOIN lab y USING (recording_id, frame_idx, point_idx) WHERE x.method <= y.method GROUP BY 1, 2, 3""", "points"),
    "h13_tagged": sql(FEATURES + """SELECT method, recording_id, count(*) AS n, count(*) FILTER (is_ghost) AS tagged, count(*) FILTER (NOT is_ghost) AS kept, round(count(*) FILTER (is_ghost) / count(*), 6) AS fraction
    FROM lab GROUP BY GROUPING SETS ((method, recording_id), (method))""", "points"),
}
