"""Queries P and A with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dopplerlake.functions.scalars import azimuth_of, rounded
from dopplerlake.operators import audit as a
from dopplerlake.operators import points as p
from dopplerlake.sources import fixtures as fx
from dopplerlake.sources.fixtures import sql

RANGE = "sqrt(x * x + y * y + z * z)"
AZIMUTH = "degrees(atan2(x, y))"
GATED = f"{RANGE} BETWEEN 0.5 AND 8 AND round(snr_db / 0.1e0) >= 10 AND abs(v) >= 0.15e0"


def _frames(s, d):
    """Frames as arrays; in every seventh the side information lacks its last entry."""
    return p.nest(fx.points(s, d)).withColumn("side", F.when(F.col("frame_idx") % 7 == 3, F.slice("side", 1, F.size("side") - 1)).otherwise(F.col("side")))


def _clock(s, d):
    return fx.audit_frames(s, d).withColumn("cycles", (F.col("frame_idx") * 1500000007) % 2**32)


#: Where the strongest point of a frame is a target.
TARGET = "snr_db >= 25"


def _tracks(s, d, best=None):
    """The strongest point of each frame with side information, over all frames; `best` has its range where it is known already."""
    if best is None:
        best = p.geometry(p.strongest(fx.points(s, d), 1).where(TARGET)).select("recording_id", "frame_idx", "range_m")
    return fx.frame_spine(s, d).join(best, ["recording_id", "frame_idx"], "left")


def _devices(s, d):
    o = fx.table(s, d, "supplier")
    devices = o.select(F.col("s_suppkey").alias("recording_id"), (F.col("s_nationkey") % 5).cast("long").alias("cfg_id"), F.when(F.col("s_suppkey") % 7 == 0, "xwr18xx").otherwise("xwr68xx").alias("platform"), F.when(F.col("s_suppkey") % 5 == 0, "3.5").otherwise("3.6").alias("sdk"))
    configs = fx.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("cfg_id"), F.lit("xwr68xx").alias("cfg_platform"), F.lit("3.6").alias("cfg_sdk"))
    return a.device_mismatch(devices, configs)


def _payload_frames(s, d):
    """Frame headers of recordings with different payloads: maps, angle samples of either kind, profiles, points alone, no points."""
    k, order = F.col("recording_id") % 5, F.col("tlv_order")
    tlv = F.when(k == 0, F.concat(order, F.lit(",5"))).when(k == 1, F.concat(order, F.lit(",3,8"))).when(k == 2, F.concat(order, F.lit(",4"))).when(k == 3, "1,7").otherwise(order)
    return fx.audit_frames(s, d).withColumns({"tlv_order": tlv, "num_points": F.when(F.col("recording_id") % 7 == 3, 0).otherwise(F.col("num_points"))})


QUERIES = {
    "p01_flatten": lambda s, d: p.flatten(_frames(s, d)),
    "p02_geometry": lambda s, d: p.geometry(fx.points(s, d)).select(*p.FRAME, "point_idx", "range_m", "azimuth_deg", "elevation_deg", "peak_db"),
    "p04_time_base": lambda s, d: p.time_base(fx.audit_frames(s, d), 0.1).select(*p.FRAME, "t"),
    "p05_unwrap_clock": lambda s, d: p.unwrap_clock(_clock(s, d)).select(*p.FRAME, "hw_t"),
    "p06_gate": lambda s, d: p.gate(fx.points(s, d)).select(*p.FRAME, "point_idx", "x", "y", "z", "v", "snr_db"),
    "p07_notch": lambda s, d: p.notch(fx.points(s, d), 0.5, 1).select(*p.FRAME, "point_idx", "v"),
    "p09_strongest": lambda s, d: p.strongest(fx.points(s, d)).select(*p.FRAME, "point_idx", "place", "snr_db"),
    "p10_subtract_background": lambda s, d: p.subtract_background(fx.points(s, d, by=tuple(p.FRAME)), p.gate(fx.background_points(s, d).withColumn("v", F.lit(1.0)))).select(*p.FRAME, "point_idx"),
    "p12_accumulate": lambda s, d: p.accumulated(fx.points(s, d), 10, 99),
    "p13_mark_static": lambda s, d: p.mark_static(fx.profile_cells(s, d), fx.points(s, d), 0.25, 0.5, 64),
    "p14_density_velocity": lambda s, d: p.density(fx.points(s, d), F.col("t"), F.col("v"), 350, 150),
    "p14_density_range": lambda s, d: p.density(p.geometry(fx.points(s, d)), F.col("t"), F.col("range_m"), 350, 200),
    "p14_density_angle": lambda s, d: p.density(fx.points(s, d), F.col("t"), azimuth_of(), 350, 180),
    "p15_figure_rows": lambda s, d: p.figure_rows(fx.points(s, d)),
    "p16_axis_limit": lambda s, d: p.axis_limit(fx.points(s, d)),
    "a01_summary": lambda s, d: a.summary(fx.audit_frames(s, d)),
    "a05_tlv_counts": lambda s, d: a.tlv_counts(fx.audit_frames(s, d)),
    "a06_tlv_orders": lambda s, d: a.tlv_orders(fx.audit_frames(s, d)),
    "a07_anomaly_counts": lambda s, d: a.anomaly_counts(fx.audit_frames(s, d)),
    "a08_field_of_view": lambda s, d: a.field_of_view(fx.points(s, d), far=4.0),
    "a10_early_stop": lambda s, d: a.early_stop(fx.audit_frames(s, d)),
    "a11_bin_check": lambda s, d: a.bin_check(fx.profile_cells(s, d), 64),
    "a12_device_mismatch": _devices,
    "a13_throughput": lambda s, d: a.throughput(fx.audit_frames(s, d), 921600),
    "a13_best_clean": lambda s, d: a.best_clean(a.throughput(fx.audit_frames(s, d), 921600)),
    "a16_availability": lambda s, d: a.availability(_payload_frames(s, d)),
    "a17_track_quality": lambda s, d: a.track_quality(_tracks(s, d)),
}
#: Results whose seventh digit is often an exact five: two more digits, so that no engine has to break a tie.
FINE = {'p06_gate', 'p01_flatten', 'p12_accumulate'}
QUERIES = {k: (lambda s, d, f=f, n=9 if k in FINE else 6: rounded(f(s, d), n)) for k, f in QUERIES.items()}


def _density(y: str, nx: int, ny: int) -> str:
    b = lambda c, n: f"CAST(least(floor(({c} - CASE WHEN lo{c} = hi{c} THEN lo{c} - 0.5 ELSE lo{c} END) / (CASE WHEN lo{c} = hi{c} THEN hi{c} + 0.5 ELSE hi{c} END - CASE WHEN lo{c} = hi{c} THEN lo{c} - 0.5 ELSE lo{c} END) * {n}), {n - 1}) AS BIGINT)"
    return sql(f""", q AS (SELECT recording_id, t AS a, {y} AS b FROM points), e AS (SELECT recording_id, min(a) loa, max(a) hia, min(b) lob, max(b) hib FROM q GROUP BY 1)
    SELECT recording_id, {b('a', nx)} AS bx, {b('b', ny)} AS "by", count(*) AS n FROM q JOIN e USING (recording_id) WHERE b IS NOT NULL GROUP BY 1, 2, 3""", "points")


_r = lambda c: f"round({c}, 6) + 0.0 AS "
KEY = "recording_id, frame_idx, point_idx"
_ARR = "list_contains(string_split(tlv_order, ','), '{}')"
PAYLOADS = f""", pf AS (SELECT recording_id, frame_idx, CASE WHEN recording_id % 7 = 3 THEN 0 ELSE num_points END AS num_points,
    CASE recording_id % 5 WHEN 0 THEN tlv_order || ',5' WHEN 1 THEN tlv_order || ',3,8' WHEN 2 THEN tlv_order || ',4' WHEN 3 THEN '1,7' ELSE tlv_order END AS tlv_order FROM audit_frames),
fl AS (SELECT recording_id, bool_or(num_points > 0) AS has_points, bool_or({_ARR.format(2)}) AS has_profile, bool_or({_ARR.format(3)}) AS has_noise, bool_or({_ARR.format(4)} OR {_ARR.format(8)}) AS has_angle, bool_or({_ARR.format(5)}) AS has_map,
    bool_or({_ARR.format(6)}) AS has_stats, bool_or({_ARR.format(7)}) AS has_side, bool_or({_ARR.format(9)}) AS has_temperature FROM pf GROUP BY 1)
"""
SQL = {
    "p01_flatten": sql(f"SELECT {KEY}, {_r('x')}x, {_r('y')}y, {_r('z')}z, {_r('v')}v, round(CASE WHEN frame_idx % 7 <> 3 THEN snr_db END, 6) + 0.0 AS snr_db, round(CASE WHEN frame_idx % 7 <> 3 THEN noise_db END, 6) + 0.0 AS noise_db FROM points", "points"),
    "p02_geometry": sql(f"SELECT {KEY}, {_r(RANGE)}range_m, {_r(AZIMUTH)}azimuth_deg, {_r('degrees(atan2(z, sqrt(x * x + y * y)))')}elevation_deg, {_r('snr_db + noise_db')}peak_db FROM points", "points"),
    "p04_time_base": sql(""", s AS (SELECT *, frame_number - lag(frame_number) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS step FROM audit_frames)
    SELECT recording_id, frame_idx, round((CASE WHEN coalesce(min(step) OVER w < 0, false) THEN frame_idx ELSE frame_number - first_value(frame_number) OVER (PARTITION BY recording_id ORDER BY frame_idx) END) * 0.1e0, 6) + 0.0 AS t FROM s WINDOW w AS (PARTITION BY recording_id)""", "audit_frames"),
    "p05_unwrap_clock": sql(""", c AS (SELECT *, (frame_idx * 1500000007) % 4294967296 AS cycles FROM audit_frames), k AS (SELECT *, lag(cycles) OVER w AS prev FROM c WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx))
    SELECT recording_id, frame_idx, round((cycles + 4294967296 * sum(CASE WHEN cycles < prev AND prev > 2147483648 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame_idx)) / 200e6, 6) + 0.0 AS hw_t FROM k""", "audit_frames"),
    "p06_gate": sql(f"SELECT {KEY}, {_r('x')}x, {_r('y')}y, {_r('z')}z, {_r('v')}v, {_r('snr_db')}snr_db FROM points WHERE {GATED}", "points"),
    "p07_notch": sql(f"SELECT {KEY}, {_r('v')}v FROM points WHERE abs(round_even(v / 0.5e0, 0)) > 1", "points"),
    "p09_strongest": sql(f"SELECT * FROM (SELECT {KEY}, row_number() OVER (PARTITION BY recording_id, frame_idx ORDER BY snr_db DESC NULLS LAST, point_idx) AS place, {_r('snr_db')}snr_db FROM points) WHERE place <= 5", "points"),
    "p10_subtract_background": sql(f""", b AS (SELECT DISTINCT recording_id, x, y, z FROM (SELECT *, 1.0e0 AS v FROM background_points) WHERE {GATED})
    SELECT {KEY} FROM points p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.recording_id = p.recording_id AND sqrt((p.x - b.x) ** 2 + (p.y - b.y) ** 2 + (p.z - b.z) ** 2) <= 0.25e0)""", "points", "background_points"),
    "p12_accumulate": sql("SELECT recording_id, shown_at, count(*) AS n, round(avg(x), 6) + 0.0 AS mean_x, round(max(y), 6) + 0.0 AS max_y FROM points, (SELECT unnest(range(100)) AS shown_at) f WHERE shown_at BETWEEN frame_idx AND frame_idx + 9 GROUP BY 1, 2", "points"),
    "p13_mark_static": sql(f""", h AS (SELECT recording_id, frame_idx, CAST(round_even({RANGE} / 0.25e0, 0) AS BIGINT) AS range_bin, count(*) AS n_static FROM points WHERE round_even(v / 0.5e0, 0) = 0 GROUP BY 1, 2, 3)
    SELECT recording_id, frame_idx, range_bin, round(value_db, 6) + 0.0 AS value_db, n_static FROM profile_cells JOIN h USING (recording_id, frame_idx, range_bin) WHERE range_bin BETWEEN 0 AND 63""", "points", "profile_cells"),
    "p14_density_velocity": _density("v", 350, 150),
    "p14_density_range": _density(RANGE, 350, 200),
    "p14_density_angle": _density(AZIMUTH, 350, 180),
    "p15_figure_rows": sql(f""", g AS (SELECT {KEY}, t, {RANGE} AS range_m, v, snr_db, {AZIMUTH} AS azimuth_deg, degrees(atan2(z, sqrt(x * x + y * y))) AS elevation_deg FROM points)
    SELECT {KEY}, {_r('t')}t, view, {_r('value')}value FROM g UNPIVOT (value FOR view IN (range_m, v, snr_db, azimuth_deg, elevation_deg))""", "points"),
    "p16_axis_limit": sql(f"SELECT recording_id, round(coalesce(greatest(2.0, quantile_cont({RANGE}, 0.995) * 1.15), 10.0), 6) + 0.0 AS limit_m FROM points GROUP BY 1", "points"),
    "a01_summary": sql(f""", g AS (SELECT *, frame_number - lag(frame_number) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS gap FROM audit_frames),
    s AS (SELECT recording_id, count(*) AS n_frames, CAST(sum(total_len) AS BIGINT) AS bytes_in_frames, CAST(sum(skipped_before) AS BIGINT) AS bytes_skipped, count(*) FILTER (skipped_before > 0) AS resyncs,
      CAST(coalesce(sum(gap - 1) FILTER (gap > 1), 0) AS BIGINT) AS frames_lost, arg_min(frame_number, frame_idx) AS first_number, arg_max(frame_number, frame_idx) AS last_number, count(*) FILTER (num_points = 0) AS zero_point_frames,
      count(*) FILTER (num_obj <> num_points) AS count_mismatches, CAST(sum(num_points) AS BIGINT) AS n_points, count(*) FILTER (NOT {_ARR.format(7)}) AS frames_without_side_info, count(*) / nullif(max(t) - min(t), 0) AS rate FROM g GROUP BY 1)
    SELECT * EXCLUDE (rate), round(rate, 6) AS fps, CASE WHEN bytes_skipped > 0 AND count_mismatches > 0 THEN 'not complete: bytes skipped, counts differ' WHEN bytes_skipped > 0 THEN 'not complete: bytes skipped' WHEN count_mismatches > 0 THEN 'not complete: counts differ' ELSE 'complete' END AS verdict FROM s""", "audit_frames"),
    "a05_tlv_counts": sql("SELECT recording_id, CAST(tlv AS INT) AS tlv, count(*) AS n FROM (SELECT recording_id, unnest(string_split(tlv_order, ',')) AS tlv FROM audit_frames) GROUP BY 1, 2", "audit_frames"),
    "a06_tlv_orders": sql("SELECT recording_id, tlv_order, count(*) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY count(*) DESC, tlv_order) AS place FROM audit_frames GROUP BY 1, 2", "audit_frames"),
    "a07_anomaly_counts": sql("SELECT recording_id, string_split(anomaly, ' (')[1] AS anomaly, count(*) AS n FROM audit_frames WHERE anomaly IS NOT NULL GROUP BY 1, 2", "audit_frames"),
    "a08_field_of_view": sql("SELECT recording_id, " + ", ".join(f"round({f}({c}), 6) + 0.0 AS {f}_{n}" for n, c in (("range", RANGE), ("v", "v"), ("azimuth", AZIMUTH), ("snr", "snr_db"), ("noise", "noise_db")) for f in ("min", "max"))
        + f", count(*) FILTER (v = 0) AS zero_doppler, count(*) FILTER ({RANGE} > 4) AS beyond_range, CAST(NULL AS BIGINT) AS beyond_doppler, count(*) FILTER (snr_db < 0) AS negative_snr, count(*) FILTER (noise_db < 0) AS negative_noise FROM points GROUP BY 1", "points"),
    "a10_early_stop": sql("""SELECT recording_id, min(frame_idx) FILTER (num_obj = 0) AS first_empty, count(*) AS n_frames, count(*) FILTER (string_split(tlv_order, ',')[1] = '1' AND len(string_split(tlv_order, ',')) >= 2 AND string_split(tlv_order, ',')[2] <> '7') AS second_not_side_info,
      coalesce(count(*) - min(frame_idx) FILTER (num_obj = 0), 0) AS frames_lost FROM audit_frames GROUP BY 1""", "audit_frames"),
    "a11_bin_check": sql("SELECT recording_id, arg_min(size, frame_idx) AS observed, CAST(64 AS BIGINT) AS configured, arg_min(size, frame_idx) = 64 AS agrees FROM (SELECT recording_id, frame_idx, count(*) AS size FROM profile_cells GROUP BY 1, 2) GROUP BY 1", "profile_cells"),
    "a12_device_mismatch": "SELECT s_suppkey AS recording_id, CAST(s_nationkey % 5 AS BIGINT) AS cfg_id, CASE WHEN s_suppkey % 7 = 0 THEN 'xwr18xx' ELSE 'xwr68xx' END AS platform, 'xwr68xx' AS cfg_platform, CASE WHEN s_suppkey % 5 = 0 THEN '3.5' ELSE '3.6' END AS sdk, '3.6' AS cfg_sdk FROM supplier JOIN region ON s_nationkey % 5 = r_regionkey WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0",
    "a13_throughput": sql("SELECT recording_id, round(count(*) / nullif(max(t) - min(t), 0), 6) AS fps, round(sum(total_len) / nullif(max(t) - min(t), 0), 6) AS bytes_per_s, round(sum(total_len) / nullif(max(t) - min(t), 0) / 92160e0, 6) AS utilisation, sum(skipped_before) = 0 AS clean FROM audit_frames GROUP BY 1", "audit_frames"),
    "a13_best_clean": sql("SELECT recording_id, round(b, 6) AS bytes_per_s FROM (SELECT recording_id, sum(total_len) / nullif(max(t) - min(t), 0) AS b FROM audit_frames GROUP BY 1 HAVING sum(skipped_before) = 0) WHERE b IS NOT NULL ORDER BY b DESC, recording_id LIMIT 1", "audit_frames"),
    "a16_availability": sql(PAYLOADS + """SELECT *, CASE WHEN has_map OR has_angle THEN 'B' WHEN has_profile THEN 'C+' ELSE 'C' END AS tier FROM fl""", "audit_frames"),
    "a17_track_quality": sql(""", m AS (SELECT recording_id, frame_idx, max(snr_db) AS best FROM points GROUP BY 1, 2), q AS (SELECT recording_id, avg(CASE WHEN best >= 25 THEN 1.0e0 ELSE 0 END) AS valid_fraction FROM frame_spine LEFT JOIN m USING (recording_id, frame_idx) GROUP BY 1)
    SELECT recording_id, round(valid_fraction, 6) AS valid_fraction, CASE WHEN valid_fraction = 0 THEN 'no target' WHEN valid_fraction < 0.25 THEN 'few measurements' ELSE 'none' END AS warning FROM q""", "points", "frame_spine"),
}
SQL |= {k: SQL[k].replace(", 6)", ", 9)") for k in FINE}
