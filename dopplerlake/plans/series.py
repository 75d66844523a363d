"""Queries G, T, B, R and D with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from dopplerlake.functions.scalars import rounded
from dopplerlake.operators import angle as b
from dopplerlake.operators import gait as g
from dopplerlake.operators import maps as m
from dopplerlake.operators import rawadc as r
from dopplerlake.operators import tracking as t
from dopplerlake.plans.maps import TRACKS, VBIN, W
from dopplerlake.plans.points import RANGE, _tracks
from dopplerlake.sources import fixtures as fx
from dopplerlake.sources.captures import parse_configs
from dopplerlake.sources.fixture_captures import config_lines
from dopplerlake.sources.fixtures import sql

FRAME = ["recording_id", "frame_idx"]


def _vt(s, d):
    return m.velocity_time_dense(fx.rd_frames(s, d), 8, 8)


def _maxima(s, d):
    """Local maxima of the envelope inside walking segments, as steps for the operators that follow."""
    e = g.smooth(fx.envelope(s, d))
    w = Window.partitionBy("recording_id").orderBy("frame_idx")
    p = e.withColumns({"a": F.lag("v").over(w), "z": F.lead("v").over(w)}).where("v > a and v > z").drop("a", "z")
    return p.join(g.segments(e).select("recording_id", "segment", "first", "last"), "recording_id", "left").where("frame_idx between first and last").drop("first", "last")


def _metrics(s, d):
    e = g.smooth(fx.envelope(s, d))
    # steps counted by hand, where somebody did
    counted = fx.table(s, d, "events").select(F.col("user_id").alias("recording_id")).distinct().where("recording_id % 3 = 0").withColumn("n_true", F.col("recording_id") % 5)
    return g.metrics(e, g.segments(e), _maxima(s, d), counted)


def _steps(s, d):
    e = g.smooth(fx.envelope(s, d))
    return g.steps(e, g.segments(e))


def _profile(s, d):
    """Linear profiles, the form that peaks are searched in."""
    return fx.emb_cells(s, d).select(*FRAME, F.col("pos").alias("bin"), F.abs("val").alias("value"))


def _peaks(s, d, n):
    return t.peaks(_profile(s, d), n, 5).withColumn("range_m", F.col("bin") * 0.25)


def _stats(s, d):
    return fx.table(s, d, "events").select(F.col("user_id").alias("recording_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("frame_idx"), (F.col("value") % 100).alias("load"), (F.col("event_id") % 5000).alias("margin_us"))


def _temperatures(s, d):
    return r.temperatures(_stats(s, d).select(*FRAME, *((F.col("load") / 2 + k).alias(f"sensor{k}") for k in range(9))), [f"sensor{k}" for k in range(9)])


#: Frames of four chirps, two receivers and eight samples.
CUBE = r.Cube(4, 2, 8)


def _rooms(s, d):
    """Each recording's empty room is the one of the next number."""
    own = fx.table(s, d, "embeddings").select(F.col("label").cast("long").alias("recording_id")).distinct()
    return own.withColumn("background_id", (F.col("recording_id") + 1) % 10)


def _clean(s, d):
    return r.remove_background(fx.adc_frames(s, d), fx.adc_frames(s, d), _rooms(s, d), CUBE)


def _arrays(s, d):
    """Configurations of the recordings: those of the same number in the configuration table; cells hold eight antennas."""
    return parse_configs(config_lines(s, d)).select(F.col("cfg_id").alias("recording_id"), "n_tx", F.lit(4).alias("n_rx"), F.lit(8).alias("n_virtual"), "slots")


QUERIES = {
    "g01_robust_mask": lambda s, d: g.robust_mask(_vt(s, d), 1.0),
    "g02_dense_envelope": lambda s, d: g.dense_envelope(_vt(s, d), 0.5, 8, 0.0, 0.0),
    "g03_point_envelope": lambda s, d: g.point_envelope(fx.points(s, d), fx.frame_spine(s, d)),
    "g04_smooth": lambda s, d: g.smooth(fx.envelope(s, d)),
    "g05_segments": lambda s, d: g.segments(g.smooth(fx.envelope(s, d))),
    "g07_steps": _steps,
    "g08_intervals": lambda s, d: g.intervals(_maxima(s, d)).select("recording_id", "segment", "frame_idx", "interval"),
    "g09_metrics": _metrics,
    "g10_spectral_cadence": lambda s, d: g.spectral_cadence(fx.envelope(s, d), 0.2, 0.5, 2.4),
    "g11_disagreement": lambda s, d: g.disagreement(_metrics(s, d), g.spectral_cadence(fx.envelope(s, d), 0.2, 0.5, 2.4)),
    "g12_interval_band": lambda s, d: g.interval_band(g.intervals(_maxima(s, d))),
    "g13_chain": lambda s, d: g.chain(_tracks(s, d), m.following_velocity_time(fx.points(s, d), _tracks(s, d), 0.5, 16), m.sparse_velocity_time(fx.points(s, d), 0.5, 16)),
    "t01_peaks": lambda s, d: _peaks(s, d, 3),
    "t02_track_one": lambda s, d: t.track_maps(_peaks(s, d, 3), fx.dense_frames(s, d).select(*FRAME), 1),
    "t02_track_two": lambda s, d: t.track_maps(_peaks(s, d, 3), fx.dense_frames(s, d).select(*FRAME), 2),
    "t03_track_points": lambda s, d: t.track_points(t.strongest_candidates(fx.points(s, d), 1, 0.15), fx.frame_spine(s, d)),
    "t03_track_points_two": lambda s, d: t.track_points(t.strongest_candidates(fx.points(s, d), 2, 0.15), fx.frame_spine(s, d), 2),
    "t04_fill": lambda s, d: t.fill_track(_tracks(s, d)).select(*FRAME, "filled_m", "interpolated"),
    "t04_fill_linear": lambda s, d: t.fill_track(_tracks(s, d), "linear").select(*FRAME, "filled_m", "interpolated"),
    "t05_track_optimal": lambda s, d: t.track_maps(_peaks(s, d, 2), fx.dense_frames(s, d).select(*FRAME), 2, optimal=True),
    "t06_separate_two": lambda s, d: t.separate_two(fx.points(s, d)),
    "b01_axis": lambda s, d: b.with_angle(b.beam_pattern(b.beamform(fx.angle_cells(s, d)), 1)),
    "b02_beamform": lambda s, d: b.beamform(fx.angle_cells(s, d)),
    "b04_azimuth_time": lambda s, d: b.azimuth_time(b.beamform(fx.angle_cells(s, d)), 1, 2),
    "b04_azimuth_following": lambda s, d: b.azimuth_time_following(b.beamform(fx.angle_cells(s, d)), _tracks(s, d), 0.5),
    "b05_beam_pattern": lambda s, d: b.beam_pattern(b.beamform(fx.angle_cells(s, d)), 1),
    "b06_azimuth_symbols": lambda s, d: b.azimuth_symbols(fx.angle_cells(s, d), _arrays(s, d)),
    "b07_cartesian": lambda s, d: b.to_cartesian(b.beamform(fx.angle_cells(s, d)), b.grid_weights(s, 16, 0.5, 4)),
    "r01_background": lambda s, d: _clean(s, d).select(*FRAME, F.posexplode("adc").alias("pos", "val")),
    "r02_range_time": lambda s, d: r.range_time(fx.adc_frames(s, d), CUBE, 1, 16),
    "r02_range_time_clean": lambda s, d: r.range_time(_clean(s, d), CUBE, 1, 16),
    "r03_velocity_time": lambda s, d: r.velocity_time(_clean(s, d), CUBE, 0, 16, 1, 7, 8),
    "r04_velocity_following": lambda s, d: r.velocity_time_following(_clean(s, d), _peaks(s, d, 1), CUBE, 1.0, 1, 16, 1.0, 8),
    "d01_processing": lambda s, d: r.processing(_stats(s, d)),
    "d02_temperatures": _temperatures,
    "d03_rolling_load": lambda s, d: r.rolling_load(_stats(s, d)),
}
#: Results whose seventh digit is often an exact five: two more digits, so that no engine has to break a tie.
FINE = {'d03_rolling_load'}
QUERIES = {k: (lambda s, d, f=f, n=9 if k in FINE else 6: rounded(f(s, d), n)) for k, f in QUERIES.items()}

VT = "SELECT recording_id, frame_idx, dop_bin AS bin, sum(value) AS value FROM rd_cells GROUP BY 1, 2, 3"
MASK = """SELECT *, value > CASE WHEN mad <= 0 THEN med ELSE med + {k} * 1.4826e0 * mad END AS kept FROM
 (SELECT *, median(abs(value - med)) OVER (PARTITION BY recording_id, frame_idx) AS mad FROM (SELECT *, median(value) OVER (PARTITION BY recording_id, frame_idx) AS med FROM ({source})))"""
SMOOTH = "SELECT recording_id, frame_idx, t, avg(v) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM envelope"
WALK = f""", sm AS ({SMOOTH}),
s1 AS (SELECT *, coalesce(last_value(CASE WHEN coalesce(v, 0) >= 0.35 THEN 1 WHEN coalesce(v, 0) < 0.2 THEN 0 END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame_idx), 0) AS st FROM sm),
s2 AS (SELECT *, CASE WHEN st <> lag(st, 1, 0) OVER (PARTITION BY recording_id ORDER BY frame_idx) THEN 1 ELSE 0 END AS turn FROM s1),
s3 AS (SELECT *, sum(turn) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS island FROM s2),
s4 AS (SELECT recording_id, min(frame_idx) AS "first", max(frame_idx) AS "last", min(t) AS t0, max(t) AS t1 FROM s3 WHERE st = 1 GROUP BY recording_id, island HAVING round(max(t) - min(t), 9) >= 1),
walk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY "first") AS segment FROM s4),
mx AS (SELECT x.recording_id, x.frame_idx, x.t, x.v, segment FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS z FROM sm WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx)) x
  JOIN walk ON walk.recording_id = x.recording_id AND x.frame_idx BETWEEN "first" AND "last" WHERE v > a AND v > z),
iv AS (SELECT * FROM (SELECT *, t - lag(t) OVER (PARTITION BY recording_id, segment ORDER BY t) AS interval_s FROM mx) WHERE interval_s IS NOT NULL),
met AS (SELECT d.recording_id, duration, coalesce(t_walk, 0) AS t_walk, coalesce(n_segments, 0) AS n_segments, coalesce(n_steps, 0) AS n_steps, mean_interval, sd_interval, median_interval,
  CASE WHEN coalesce(t_walk, 0) > 0 THEN 60.0e0 * coalesce(n_steps, 0) / t_walk ELSE 0 END AS cadence FROM (SELECT recording_id, max(t) - min(t) AS duration FROM sm GROUP BY 1) d
  LEFT JOIN (SELECT recording_id, sum(t1 - t0) AS t_walk, count(*) AS n_segments FROM walk GROUP BY 1) USING (recording_id) LEFT JOIN (SELECT recording_id, count(*) AS n_steps FROM mx GROUP BY 1) USING (recording_id)
  LEFT JOIN (SELECT recording_id, avg(interval_s) AS mean_interval, stddev_samp(interval_s) AS sd_interval, median(interval_s) AS median_interval FROM iv GROUP BY 1) USING (recording_id))
"""
SPECTRUM = f""", e0 AS (SELECT recording_id, coalesce(v, 0) AS v, count(*) OVER (PARTITION BY recording_id) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - 1 AS i, avg(coalesce(v, 0)) OVER (PARTITION BY recording_id) AS mean FROM envelope),
e1 AS (SELECT *, (v - mean) * (0.5 - 0.5 * cos(2 * {math.pi!r} * i / (n - 1))) AS x FROM e0 WHERE n >= 8),
e2 AS (SELECT recording_id, n, k, sqrt(sum(x * cos(2 * {math.pi!r} * ((k * i) % n) / n)) ** 2 + sum(x * sin(2 * {math.pi!r} * ((k * i) % n) / n)) ** 2) AS m FROM e1, (SELECT unnest(range(20000)) AS k)
  WHERE k BETWEEN ceil(0.5e0 * n * 0.2e0 - 1e-9) AND least(floor(2.4e0 * n * 0.2e0 + 1e-9), floor(n / 2)) GROUP BY 1, 2, 3),
sp AS (SELECT recording_id, 60.0e0 * arg_max(k, (round(m, 9), -k)) / (any_value(n) * 0.2e0) AS cadence_spectral, CASE WHEN sum(m) > 0 THEN max(m) / sum(m) ELSE 0 END AS confidence FROM e2 GROUP BY 1
  UNION ALL SELECT recording_id, NULL, 0 FROM e0 GROUP BY 1 HAVING count(*) < 8)
"""
FILL = f""", tr AS (SELECT recording_id, frame_idx, range_m FROM frame_spine LEFT JOIN ({TRACKS}) USING (recording_id, frame_idx)),
fl AS (SELECT *, count(range_m) OVER (PARTITION BY recording_id) AS n, last_value(range_m IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN range_m IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER p AS i0,
  first_value(range_m IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN range_m IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER f AS i1 FROM tr
  WINDOW p AS (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
kn AS (SELECT recording_id, frame_idx AS i, range_m AS v, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS a, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx DESC) AS z FROM tr WHERE range_m IS NOT NULL),
en AS (SELECT recording_id, max(i) FILTER (a = 1) AS p1, max(v) FILTER (a = 1) AS q1, max(i) FILTER (a = 2) AS p2, max(v) FILTER (a = 2) AS q2, max(i) FILTER (z = 1) AS y1, max(v) FILTER (z = 1) AS x1, max(i) FILTER (z = 2) AS y2, max(v) FILTER (z = 2) AS x2 FROM kn GROUP BY 1)
"""
_INNER = "v0 + (v1 - v0) * (frame_idx - i0) / (i1 - i0)"
BEAM = f""", bm AS (SELECT recording_id, frame_idx, range_bin, k AS angle_bin,
  sqrt(sum(re * cos(ph) - im * sin(ph)) ** 2 + sum(re * sin(ph) + im * cos(ph)) ** 2) AS mag FROM (SELECT *, -2 * {math.pi!r} * ((((31 - k) * ant) % 64 + 64) % 64) / 64 AS ph FROM angle_cells, (SELECT unnest(range(63)) AS k)) GROUP BY 1, 2, 3, 4)
"""
_sum = lambda where: sql(BEAM + f"SELECT recording_id, frame_idx, angle_bin, round(sum(mag), 6) + 0.0 AS mag FROM bm {where} GROUP BY 1, 2, 3", "angle_cells")
_STATS = "(SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value % 100 AS load, event_id % 5000 AS margin_us FROM events)"
FOLLOW = f"SELECT recording_id, frame_idx, {VBIN} AS bin, sum({W}) AS value FROM points JOIN ({TRACKS}) USING (recording_id, frame_idx) WHERE abs({RANGE} - range_m) <= 0.25 GROUP BY 1, 2, 3"
FIXED = f"SELECT recording_id, frame_idx, {VBIN} AS bin, sum({W}) AS value FROM points GROUP BY 1, 2, 3"
CLEAN = """, ac AS (SELECT recording_id, frame_idx, pos, pos // 16 AS chirp, pos // 8 % 2 AS rx, pos % 8 AS sample, val, row_number() OVER (PARTITION BY recording_id, pos ORDER BY frame_idx) AS i, count(*) OVER (PARTITION BY recording_id, pos) AS n FROM emb_cells),
nf AS (SELECT DISTINCT recording_id, n FROM ac), pr AS (SELECT a.recording_id, b.recording_id AS room, least(a.n, b.n) AS kept FROM nf a JOIN nf b ON b.recording_id = (a.recording_id + 1) % 10),
mn AS (SELECT pr.recording_id, pos, avg(val) AS mean FROM pr JOIN ac ON ac.recording_id = room AND i <= kept GROUP BY 1, 2),
cl AS (SELECT recording_id, frame_idx, pos, chirp, rx, sample, val - mean AS val FROM ac JOIN pr USING (recording_id) JOIN mn USING (recording_id, pos) WHERE i <= kept)
"""
RFFT = lambda source, rx: f""", w0 AS (SELECT *, val * (0.5 - 0.5 * cos(2 * {math.pi!r} * sample / 8)) AS y FROM {source} WHERE rx = {rx}),
rf AS (SELECT recording_id, frame_idx, chirp, bin, sum(y * cos(2 * {math.pi!r} * ((bin * sample) % 16) / 16)) AS re, -sum(y * sin(2 * {math.pi!r} * ((bin * sample) % 16) / 16)) AS im FROM w0, (SELECT unnest(range(16)) AS bin) GROUP BY 1, 2, 3, 4)
"""  # noqa: E731
_RT = "SELECT recording_id, frame_idx, CAST(bin AS INT) AS bin, round(avg(sqrt(re * re + im * im)), 6) + 0.0 AS value FROM rf GROUP BY 1, 2, 3"
#: Doppler over eight bins of the four chirps in `co`.
_VT = f"""SELECT recording_id, frame_idx, CAST((k + 4) % 8 AS INT) AS bin, round(sqrt(sum(re * cos(ph) + im * sin(ph)) ** 2 + sum(im * cos(ph) - re * sin(ph)) ** 2), 6) + 0.0 AS value
  FROM (SELECT *, 2 * {math.pi!r} * ((k * chirp) % 8) / 8 AS ph FROM co, (SELECT unnest(range(8)) AS k)) GROUP BY 1, 2, 3"""
_H = f"(0.5 - 0.5 * cos(2 * {math.pi!r} * chirp / 4))"
#: Candidates of each frame from points: the strongest, and the strongest of those 0.4 m or more from it.
CANDIDATES = f""", cp AS (SELECT recording_id, frame_idx, point_idx, {RANGE} AS range_m, {W} AS w FROM points WHERE abs(v) >= 0.15),
c1 AS (SELECT recording_id, frame_idx, arg_max(range_m, (w, -point_idx)) AS a FROM cp GROUP BY 1, 2),
c2 AS (SELECT recording_id, frame_idx, arg_max(range_m, (w, -point_idx)) AS b FROM cp JOIN c1 USING (recording_id, frame_idx) WHERE abs(range_m - a) >= 0.4 GROUP BY 1, 2),
fr AS MATERIALIZED (SELECT recording_id, frame_idx, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS i, a, b FROM frame_spine LEFT JOIN c1 USING (recording_id, frame_idx) LEFT JOIN c2 USING (recording_id, frame_idx)),
"""
#: One target from points, frame by frame: x is the track's range, m its misses, y what the frame shows.
FOLLOW_ONE = """walk AS (
  SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame_idx, CAST(NULL AS DOUBLE) AS x, 0 AS m, CAST(NULL AS DOUBLE) AS y FROM fr
  UNION ALL
  SELECT recording_id, i, frame_idx, CASE WHEN hit THEN a WHEN a IS NOT NULL AND m >= 10 THEN NULL ELSE x END, CASE WHEN hit THEN 0 WHEN x IS NULL THEN m WHEN a IS NOT NULL AND m >= 10 THEN 0 ELSE m + 1 END, CASE WHEN hit THEN a WHEN m < 10 THEN x END
  FROM (SELECT fr.*, x, m, a IS NOT NULL AND (x IS NULL OR abs(a - x) <= 0.6) AS hit FROM walk JOIN fr ON fr.recording_id = walk.recording_id AND fr.i = walk.i + 1))
SELECT recording_id, frame_idx, CAST(0 AS BIGINT) AS target, round(y, 6) AS range_m, y IS NOT NULL AND m > 0 AS coasted FROM walk WHERE i > 0"""
_PAIRS = "list_sort(list_filter([{'d': abs(a - x0), 'k': 0, 'j': 1}, {'d': abs(b - x0), 'k': 0, 'j': 2}, {'d': abs(a - x1), 'k': 1, 'j': 1}, {'d': abs(b - x1), 'k': 1, 'j': 2}], lambda q: q.d IS NOT NULL AND q.d <= 0.6))"
_kept = lambda k: f"CASE WHEN h{k} IS NOT NULL THEN h{k} WHEN a IS NOT NULL AND m{k} >= 10 THEN NULL ELSE x{k} END, CASE WHEN h{k} IS NOT NULL THEN 0 WHEN x{k} IS NULL THEN m{k} WHEN a IS NOT NULL AND m{k} >= 10 THEN 0 ELSE m{k} + 1 END, CASE WHEN h{k} IS NOT NULL THEN h{k} WHEN m{k} < 10 THEN x{k} END"
_hit = lambda k: f"CASE WHEN x0 IS NULL AND x1 IS NULL THEN {('CASE WHEN b IS NULL THEN a ELSE least(a, b) END', 'greatest(a, b) + 0 * b')[k]} WHEN p.k = {k} THEN CASE p.j WHEN 1 THEN a ELSE b END WHEN q.k = {k} THEN CASE q.j WHEN 1 THEN a ELSE b END END AS h{k}"
FOLLOW_TWO_BODY = f"""walk AS (
  SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame_idx, CAST(NULL AS DOUBLE) AS x0, 0 AS m0, CAST(NULL AS DOUBLE) AS y0, CAST(NULL AS DOUBLE) AS x1, 0 AS m1, CAST(NULL AS DOUBLE) AS y1 FROM fr
  UNION ALL
  SELECT recording_id, i, frame_idx, {_kept(0)}, {_kept(1)}
  FROM (SELECT *, {_hit(0)}, {_hit(1)} FROM (SELECT *, list_filter(pairs, lambda q: q.k <> p.k AND q.j <> p.j)[1] AS q FROM (SELECT *, pairs[1] AS p FROM (SELECT fr.*, x0, m0, x1, m1, {_PAIRS} AS pairs FROM walk JOIN fr ON fr.recording_id = walk.recording_id AND fr.i = walk.i + 1)))))
SELECT recording_id, frame_idx, CAST(0 AS BIGINT) AS target, round(y0, 6) AS range_m, y0 IS NOT NULL AND m0 > 0 AS coasted FROM walk WHERE i > 0
UNION ALL SELECT recording_id, frame_idx, CAST(1 AS BIGINT), round(y1, 6), y1 IS NOT NULL AND m1 > 0 FROM walk WHERE i > 0"""
#: Up to `n` profile peaks of a frame as a sorted list of ranges, and frames in order.
PEAKS = """, p0 AS (SELECT recording_id, frame_idx, pos AS bin, abs(val) AS v FROM emb_cells),
p1 AS (SELECT recording_id, frame_idx, arg_max(bin, (v, -bin)) AS b1 FROM p0 WHERE v > 0 GROUP BY 1, 2),
p2 AS (SELECT recording_id, frame_idx, arg_max(bin, (v, -bin)) AS b2 FROM p0 JOIN p1 USING (recording_id, frame_idx) WHERE v > 0 AND abs(bin - b1) >= 5 GROUP BY 1, 2),
p3 AS (SELECT recording_id, frame_idx, arg_max(bin, (v, -bin)) AS b3 FROM p0 JOIN p1 USING (recording_id, frame_idx) JOIN p2 USING (recording_id, frame_idx) WHERE v > 0 AND abs(bin - b1) >= 5 AND abs(bin - b2) >= 5 GROUP BY 1, 2)
"""
_lists = lambda n: PEAKS + f""", pl AS (SELECT recording_id, frame_idx, list_sort(list(bin * 0.25e0)) AS c FROM ({' UNION ALL '.join(f'SELECT recording_id, frame_idx, b{k} AS bin FROM p{k}' for k in range(1, n + 1))}) GROUP BY 1, 2),
fr AS MATERIALIZED (SELECT recording_id, frame_idx, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS i, coalesce(c, []) AS c FROM (SELECT DISTINCT recording_id, frame_idx FROM emb_cells) LEFT JOIN pl USING (recording_id, frame_idx)),
"""  # noqa: E731
ONE = """walk AS (
  SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame_idx, CAST(NULL AS DOUBLE) AS x, 0 AS missed FROM fr
  UNION ALL
  SELECT recording_id, i, frame_idx, CASE WHEN i = 1 THEN c[1] WHEN best.d <= 0.6 THEN best.y ELSE x END, CASE WHEN i = 1 OR x IS NULL OR best.d <= 0.6 THEN 0 ELSE missed + 1 END
  FROM (SELECT fr.*, x, missed, list_sort(list_transform(c, lambda y: {'d': abs(y - x), 'y': y}))[1] AS best FROM walk JOIN fr ON fr.recording_id = walk.recording_id AND fr.i = walk.i + 1))
SELECT recording_id, frame_idx, CAST(0 AS BIGINT) AS target, round(CASE WHEN missed <= 10 THEN x END, 6) AS range_m, x IS NOT NULL AND missed BETWEEN 1 AND 10 AS coasted FROM walk WHERE i > 0"""
_GREEDY = """SELECT *, list_filter(pairs, lambda q: q.i <> p.i AND q.j <> p.j)[1] AS q FROM (SELECT *, pairs[1] AS p FROM (SELECT *, list_sort(list_concat(
    list_transform(range(1, len(c) + 1), lambda j: {'d': abs(x0 - c[j]), 'i': 0, 'j': j}), list_transform(range(1, len(c) + 1), lambda j: {'d': abs(x1 - c[j]), 'i': 1, 'j': j}))) AS pairs FROM st))"""
_OPTIMAL = """SELECT *, CASE WHEN len(c) = 0 THEN NULL WHEN len(c) = 1 THEN CASE WHEN abs(x0 - c[1]) <= abs(x1 - c[1]) THEN {'d': abs(x0 - c[1]), 'i': 0, 'j': 1} ELSE {'d': abs(x1 - c[1]), 'i': 1, 'j': 1} END
      WHEN abs(x0 - c[1]) + abs(x1 - c[2]) <= abs(x0 - c[2]) + abs(x1 - c[1]) THEN {'d': abs(x0 - c[1]), 'i': 0, 'j': 1} ELSE {'d': abs(x0 - c[2]), 'i': 0, 'j': 2} END AS p,
    CASE WHEN len(c) < 2 THEN NULL WHEN abs(x0 - c[1]) + abs(x1 - c[2]) <= abs(x0 - c[2]) + abs(x1 - c[1]) THEN {'d': abs(x1 - c[2]), 'i': 1, 'j': 2} ELSE {'d': abs(x1 - c[1]), 'i': 1, 'j': 1} END AS q FROM st"""
_two = lambda match: f"""walk AS (
  SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame_idx, CAST(NULL AS DOUBLE) AS x0, CAST(NULL AS DOUBLE) AS x1, 0 AS m0, 0 AS m1 FROM fr
  UNION ALL
  SELECT recording_id, i, frame_idx, CASE WHEN i = 1 THEN c[1] ELSE coalesce(c[j0], x0) END, CASE WHEN i = 1 THEN c[2] ELSE coalesce(c[j1], x1) END,
    CASE WHEN i = 1 OR x0 IS NULL OR j0 IS NOT NULL THEN 0 ELSE m0 + 1 END, CASE WHEN i = 1 OR x1 IS NULL OR j1 IS NOT NULL THEN 0 ELSE m1 + 1 END
  FROM (SELECT *, CASE WHEN p.i = 0 AND p.d <= 0.6 THEN p.j WHEN q.i = 0 AND q.d <= 0.6 THEN q.j END AS j0, CASE WHEN p.i = 1 AND p.d <= 0.6 THEN p.j WHEN q.i = 1 AND q.d <= 0.6 THEN q.j END AS j1 FROM ({match.replace('FROM st', 'FROM (SELECT fr.*, x0, x1, m0, m1 FROM walk JOIN fr ON fr.recording_id = walk.recording_id AND fr.i = walk.i + 1)')})))
SELECT recording_id, frame_idx, CAST(0 AS BIGINT) AS target, round(CASE WHEN m0 <= 10 THEN x0 END, 6) AS range_m, x0 IS NOT NULL AND m0 BETWEEN 1 AND 10 AS coasted FROM walk WHERE i > 0
UNION ALL SELECT recording_id, frame_idx, CAST(1 AS BIGINT), round(CASE WHEN m1 <= 10 THEN x1 END, 6), x1 IS NOT NULL AND m1 BETWEEN 1 AND 10 FROM walk WHERE i > 0"""  # noqa: E731
_recursive = lambda body, *views: sql(body, *views).replace("WITH", "WITH RECURSIVE", 1)
#: Steps of the envelope: level stretches above both neighbours, thinned highest first, with the prominence of a scan to either side.
STEPS = WALK.rstrip() + """, sx AS MATERIALIZED (SELECT recording_id, frame_idx, t, v, coalesce(v, 0) AS x, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - 1 AS i FROM sm),
st1 AS (SELECT *, sum(step) OVER (PARTITION BY recording_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY recording_id ORDER BY i) THEN 0 ELSE 1 END AS step FROM sx)),
lv AS (SELECT recording_id, g, (min(i) + max(i)) // 2 AS i, any_value(x) AS x FROM st1 GROUP BY 1, 2),
th AS (SELECT recording_id, greatest(1, coalesce(round_even(0.25e0 / median(dt), 0), 1)) AS apart, greatest(0.15e0 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)), 1e-6) AS least FROM (SELECT *, t - lag(t) OVER (PARTITION BY recording_id ORDER BY i) AS dt FROM sx) GROUP BY 1),
pk AS (SELECT recording_id, i, x, apart, coalesce(least, 1e-6) AS least, row_number() OVER (PARTITION BY recording_id ORDER BY x DESC, i DESC) AS k FROM (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS z FROM lv WINDOW w AS (PARTITION BY recording_id ORDER BY g)) JOIN th USING (recording_id) WHERE x > a AND x > z AND x >= 0.2e0),
thin AS (SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM pk
  UNION ALL SELECT recording_id, k, CASE WHEN list_any_value(list_filter(kept, lambda o: abs(o - i) < apart)) IS NULL THEN list_append(kept, i) ELSE kept END FROM (SELECT pk.*, kept FROM thin JOIN pk ON pk.recording_id = thin.recording_id AND pk.k = thin.k + 1)),
al AS (SELECT recording_id, unnest(kept) AS i FROM thin QUALIFY k = max(k) OVER (PARTITION BY recording_id)),
bs AS (SELECT recording_id, i, any_value(least) AS least, any_value(x) AS x, any_value(lo) AS lo, any_value(hi) AS hi FROM (SELECT pk.*, max(o.i) FILTER (o.i < pk.i AND o.x > pk.x) OVER p AS lo, min(o.i) FILTER (o.i > pk.i AND o.x > pk.x) OVER p AS hi FROM pk JOIN al USING (recording_id, i) JOIN sx o ON o.recording_id = pk.recording_id WINDOW p AS (PARTITION BY pk.recording_id, pk.i)) GROUP BY 1, 2),
pr AS (SELECT bs.recording_id, bs.i FROM bs JOIN sx o ON o.recording_id = bs.recording_id AND o.i > coalesce(lo, -1) AND o.i < coalesce(hi, 9e9) GROUP BY 1, 2, bs.x, least HAVING bs.x - greatest(min(o.x) FILTER (o.i <= bs.i), min(o.x) FILTER (o.i >= bs.i)) >= least),
hit AS (SELECT sx.recording_id, frame_idx, t, v, segment FROM pr JOIN sx USING (recording_id, i) LEFT JOIN walk ON walk.recording_id = sx.recording_id AND frame_idx BETWEEN "first" AND "last")
SELECT recording_id, frame_idx, round(t, 6) + 0.0 AS t, round(v, 6) + 0.0 AS v, segment FROM hit WHERE segment IS NOT NULL OR recording_id NOT IN (SELECT recording_id FROM walk)"""
FOLLOW_TWO = _recursive(CANDIDATES + FOLLOW_TWO_BODY, "points", "frame_spine")
SQL = {
    "t02_track_one": _recursive(_lists(3) + ONE, "emb_cells"),
    "t02_track_two": _recursive(_lists(3) + _two(_GREEDY), "emb_cells"),
    "t05_track_optimal": _recursive(_lists(2) + _two(_OPTIMAL), "emb_cells"),
    "t03_track_points": _recursive(CANDIDATES + FOLLOW_ONE, "points", "frame_spine"),
    "t03_track_points_two": FOLLOW_TWO,
    "r04_velocity_following": sql(CLEAN + RFFT("cl", 1) + PEAKS + f""", co AS (SELECT recording_id, frame_idx, chirp, sum(re) * any_value({_H}) AS re, sum(im) * any_value({_H}) AS im
        FROM rf JOIN (SELECT recording_id, frame_idx, arg_min(k, (abs(k - b1 * 0.25e0), k)) AS nb FROM p1, (SELECT unnest(range(16)) AS k) GROUP BY 1, 2) USING (recording_id, frame_idx) WHERE abs(bin - nb) <= 1 GROUP BY 1, 2, 3) {_VT}""", "emb_cells"),
    "g01_robust_mask": sql("SELECT recording_id, frame_idx, bin, round(value, 6) + 0.0 AS value, kept FROM (" + MASK.format(k=1, source=VT) + ")", "rd_cells"),
    "g02_dense_envelope": sql("SELECT recording_id, frame_idx, round(quantile_cont(abs((bin - 4) * 0.5e0), 0.98) FILTER (kept AND abs(bin - 4) > 1), 6) AS v, round(count(*) FILTER (kept AND abs(bin - 4) > 1) / count(*), 6) AS mask_fraction FROM (" + MASK.format(k=0, source=VT) + ") GROUP BY 1, 2", "rd_cells"),
    "g03_point_envelope": sql(", e AS (SELECT recording_id, frame_idx, CASE WHEN count(*) < 3 THEN max(value) ELSE coalesce(quantile_cont(value, 0.98) FILTER (kept), quantile_cont(value, 0.98) FILTER (value >= med)) END AS v FROM (" + MASK.format(k=3, source="SELECT recording_id, frame_idx, abs(v) AS value FROM points")
        + ") GROUP BY 1, 2) SELECT recording_id, frame_idx, round(t, 6) AS t, round(v, 6) + 0.0 AS v FROM frame_spine LEFT JOIN e USING (recording_id, frame_idx)", "points", "frame_spine"),
    "g04_smooth": sql(f"SELECT recording_id, frame_idx, round(t, 6) + 0.0 AS t, round(v, 6) + 0.0 AS v FROM ({SMOOTH})", "envelope"),
    "g05_segments": sql(WALK + 'SELECT recording_id, "first", "last", round(t0, 6) + 0.0 AS t0, round(t1, 6) + 0.0 AS t1, segment FROM walk', "envelope"),
    "g07_steps": _recursive(STEPS, "envelope"),
    "g08_intervals": sql(WALK + 'SELECT recording_id, segment, frame_idx, round(interval_s, 6) AS "interval" FROM iv', "envelope"),
    "g09_metrics": sql(WALK + """SELECT recording_id, round(duration, 6) + 0.0 AS duration, round(t_walk, 6) + 0.0 AS t_walk, n_segments, n_steps, round(mean_interval, 6) AS mean_interval, round(sd_interval, 6) AS sd_interval, round(median_interval, 6) AS median_interval,
      round(cadence, 6) + 0.0 AS cadence, round(CASE WHEN mean_interval > 0 THEN 100 * sd_interval / mean_interval END, 6) AS cv_percent, round(CASE WHEN duration > 0 THEN t_walk / duration ELSE 0 END, 6) + 0.0 AS walking_fraction, round(CASE WHEN recording_id % 3 = 0 AND recording_id % 5 > 0 THEN 100.0e0 * abs(n_steps - recording_id % 5) / (recording_id % 5) END, 6) + 0.0 AS mape_percent FROM met""", "envelope"),
    "g10_spectral_cadence": sql(SPECTRUM + "SELECT recording_id, round(cadence_spectral, 6) AS cadence_spectral, round(confidence, 6) AS confidence FROM sp", "envelope"),
    "g11_disagreement": sql(WALK + SPECTRUM + "SELECT recording_id, round(cadence, 6) + 0.0 AS cadence, round(cadence_spectral, 6) AS cadence_spectral, round(CASE WHEN cadence > 0 THEN 100 * abs(cadence - cadence_spectral) / cadence END, 6) + 0.0 AS disagreement_percent FROM met JOIN sp USING (recording_id)", "envelope"),
    "g12_interval_band": sql(WALK + """SELECT recording_id, segment, round(t, 6) AS t, round(interval_s, 6) AS "interval", round(avg(interval_s) OVER w, 6) AS mean, round(avg(interval_s) OVER w - coalesce(stddev_samp(interval_s) OVER w, 0), 6) + 0.0 AS low,
      round(avg(interval_s) OVER w + coalesce(stddev_samp(interval_s) OVER w, 0), 6) AS high FROM iv WINDOW w AS (PARTITION BY recording_id)""", "envelope"),
    "g13_chain": sql(f""", q AS (SELECT recording_id, count(range_m) AS n FROM frame_spine LEFT JOIN ({TRACKS}) USING (recording_id, frame_idx) GROUP BY 1)
      SELECT recording_id, frame_idx, bin, round(value, 6) AS value, 'track' AS source FROM ({FOLLOW}) JOIN q USING (recording_id) WHERE n > 0 UNION ALL SELECT recording_id, frame_idx, bin, round(value, 6), 'fixed' FROM ({FIXED}) JOIN q USING (recording_id) WHERE n = 0""", "points", "frame_spine"),
    "t04_fill": sql(FILL + f"SELECT recording_id, frame_idx, round(x, 6) AS filled_m, range_m IS NULL AND x IS NOT NULL AS interpolated FROM (SELECT *, CASE WHEN range_m IS NOT NULL THEN range_m WHEN n >= 2 THEN CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE {_INNER} END END AS x FROM fl)", "points", "frame_spine"),
    "t04_fill_linear": sql(FILL + f"""SELECT recording_id, frame_idx, round(x, 6) AS filled_m, range_m IS NULL AND x IS NOT NULL AS interpolated FROM (SELECT *, CASE WHEN range_m IS NOT NULL THEN range_m WHEN n >= 2 THEN
      CASE WHEN v0 IS NULL THEN q1 + (q2 - q1) * (frame_idx - p1) / (p2 - p1) WHEN v1 IS NULL THEN x2 + (x1 - x2) * (frame_idx - y2) / (y1 - y2) ELSE {_INNER} END END AS x FROM fl LEFT JOIN en USING (recording_id))""", "points", "frame_spine"),
    "b01_axis": sql(BEAM + "SELECT recording_id, frame_idx, angle_bin, round(sum(mag), 6) + 0.0 AS mag, round(degrees(asin(2 * (31 - angle_bin) / 64)), 6) + 0.0 AS angle_deg FROM bm WHERE abs(range_bin - 1) <= 1 GROUP BY 1, 2, 3", "angle_cells"),
    "b02_beamform": sql(BEAM + "SELECT recording_id, frame_idx, range_bin, angle_bin, round(mag, 6) + 0.0 AS mag FROM bm", "angle_cells"),
    "b04_azimuth_time": _sum("WHERE range_bin BETWEEN 1 AND 2"),
    "b04_azimuth_following": sql(BEAM + f"SELECT recording_id, frame_idx, angle_bin, round(sum(mag), 6) + 0.0 AS mag FROM bm JOIN ({TRACKS}) USING (recording_id, frame_idx) WHERE abs(range_bin * 0.5e0 - range_m) <= 0.5 GROUP BY 1, 2, 3", "points", "angle_cells"),
    "b05_beam_pattern": _sum("WHERE abs(range_bin - 1) <= 1"),
    "b06_azimuth_symbols": sql(""", cf AS (SELECT p_partkey AS recording_id, bit_count(p_partkey % 7 + 1) AS n_tx, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN [0, 2, 1] ELSE [0, -1, 1] END ELSE CASE WHEN p_partkey % 3 = 0 THEN [0, 1, 2] ELSE [0, 1, -1] END END AS sl FROM part),
      pr AS (SELECT recording_id, CASE WHEN n_tx = 1 AND sl[2] < 0 AND sl[3] < 0 THEN [3, 1] WHEN n_tx = 2 AND sl[2] >= 0 AND sl[3] < 0 THEN [sl[2] * 4 + 3, sl[2] * 4 + 1] WHEN n_tx = 2 AND sl[2] < 0 AND sl[3] >= 0 THEN [sl[3] * 4 + 3, sl[3] * 4 + 1]
        WHEN n_tx = 3 AND sl[2] >= 0 AND sl[3] >= 0 THEN [sl[3] * 4 + 3, sl[3] * 4 + 1, sl[2] * 4 + 3, sl[2] * 4 + 1] END AS places FROM cf)
      SELECT recording_id, frame_idx, range_bin, CAST(list_position(places, ant) - 1 AS BIGINT) AS ant, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM angle_cells JOIN pr USING (recording_id) WHERE list_max(places) < 8 AND list_position(places, ant) > 0""", "angle_cells"),
    "r01_background": sql(CLEAN + "SELECT recording_id, frame_idx, CAST(pos AS INT) AS pos, round(val, 6) + 0.0 AS val FROM cl", "emb_cells"),
    "r02_range_time": sql(CLEAN + RFFT("ac", 1) + _RT, "emb_cells"),
    "r02_range_time_clean": sql(CLEAN + RFFT("cl", 1) + _RT, "emb_cells"),
    "r03_velocity_time": sql(CLEAN + RFFT("cl", 0) + f""", best AS (SELECT recording_id, frame_idx, arg_max(bin, (m, -bin)) AS bin FROM (SELECT recording_id, frame_idx, bin, round(avg(sqrt(re * re + im * im)), 9) AS m FROM rf WHERE bin BETWEEN 1 AND 7 GROUP BY 1, 2, 3) GROUP BY 1, 2),
      co AS (SELECT recording_id, frame_idx, chirp, re * {_H} AS re, im * {_H} AS im FROM rf JOIN best USING (recording_id, frame_idx, bin)) {_VT}""", "emb_cells"),
    "t01_peaks": sql(""", p0 AS (SELECT recording_id, frame_idx, pos AS bin, abs(val) AS v FROM emb_cells),
      p1 AS (SELECT recording_id, frame_idx, arg_max(bin, (v, -bin)) AS b1 FROM p0 WHERE v > 0 GROUP BY 1, 2),
      p2 AS (SELECT recording_id, frame_idx, arg_max(bin, (v, -bin)) AS b2 FROM p0 JOIN p1 USING (recording_id, frame_idx) WHERE v > 0 AND abs(bin - b1) >= 5 GROUP BY 1, 2),
      p3 AS (SELECT recording_id, frame_idx, arg_max(bin, (v, -bin)) AS b3 FROM p0 JOIN p1 USING (recording_id, frame_idx) JOIN p2 USING (recording_id, frame_idx) WHERE v > 0 AND abs(bin - b1) >= 5 AND abs(bin - b2) >= 5 GROUP BY 1, 2)
      SELECT recording_id, frame_idx, bin, bin * 0.25e0 AS range_m FROM (SELECT recording_id, frame_idx, b1 AS bin FROM p1 UNION ALL SELECT recording_id, frame_idx, b2 FROM p2 UNION ALL SELECT recording_id, frame_idx, b3 FROM p3)""", "emb_cells"),
    "b07_cartesian": sql(BEAM + """, g0 AS (SELECT gx, gy, -1.5e0 + 2 * 1.5e0 * gx / 15 AS x, 1.5e0 * gy / 15 AS y FROM (SELECT unnest(range(16)) AS gx), (SELECT unnest(range(16)) AS gy)),
      g1 AS (SELECT *, sqrt(x * x + y * y) AS h FROM g0), g2 AS (SELECT gx, gy, h / 0.5e0 AS r, 31 - CASE WHEN h > 0 THEN x / h ELSE 0 END * 64 / 2 AS u FROM g1),
      g3 AS (SELECT gx, gy, CAST(floor(r) AS BIGINT) + a AS range_bin, CAST(floor(u) AS BIGINT) + b AS angle_bin, (CASE WHEN a = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE WHEN b = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS w
        FROM g2, (SELECT unnest(range(2)) AS a), (SELECT unnest(range(2)) AS b) WHERE r <= 3 AND u BETWEEN 0 AND 62)
      SELECT recording_id, frame_idx, gx, gy, round(sum(mag * w), 6) + 0.0 AS mag FROM bm JOIN g3 USING (range_bin, angle_bin) WHERE w > 0 GROUP BY 1, 2, 3, 4""", "angle_cells"),
    "d01_processing": f"SELECT recording_id, round(avg(load), 6) AS mean_load, round(min(margin_us / 1000), 6) AS min_margin_ms, min(margin_us / 1000) < 1 AS at_risk FROM {_STATS} GROUP BY 1",
    "d02_temperatures": f"SELECT recording_id, frame_idx, 'sensor' || k AS sensor, round(load / 2 + k, 6) AS celsius FROM {_STATS}, (SELECT unnest(range(9)) AS k)",
    "d03_rolling_load": f"SELECT recording_id, frame_idx, round(avg(load) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) + 0.0 AS rolling_load FROM {_STATS}",
}
SQL |= {k: SQL[k].replace(", 6)", ", 9)") for k in FINE}
