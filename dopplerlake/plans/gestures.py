"""Queries F with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from dopplerlake.functions.scalars import rounded
from dopplerlake.operators import gesture as g
from dopplerlake.operators import network
from dopplerlake.plans.points import AZIMUTH, RANGE
from dopplerlake.sources import fixtures as fx
from dopplerlake.sources.fixtures import sql

FRAME = g.FRAME
COLUMNS = ["f0", "f5", "f6", "f4", "f3", "f7"]
MEANS, SDS = [0.1, 0.0, -0.1, 0.2, 0.0, 0.05], [1.0, 2.0, 1.5, 1.0, 0.5, 2.0]


def _features(s, d):
    """Ten features a frame as columns f0..f9, and a session label."""
    c = fx.gesture_cells(s, d)
    return c.groupBy(*FRAME).agg(*(F.max(F.when(F.col("k") == k, F.col("feature"))).alias(f"f{k}") for k in range(10))).withColumn("label", (F.col("recording_id") % 10).cast("int"))


def _probs(s, d):
    c = fx.gesture_cells(s, d)
    a = F.array_sort(F.collect_list(F.struct("k", "prob")))
    return c.groupBy(*FRAME).agg(F.transform(a, lambda x: x["prob"]).alias("probs"))


EASY, FEW = (0.2,) * 10, (1,) * 10


def _states(s, d):
    return g.debounce(_probs(s, d), EASY, FEW)


def _host(s, d):
    return _probs(s, d).withColumn("probs", F.reverse("probs"))


def _point_features(s, d):
    return g.point_features(fx.points(s, d), fx.frame_spine(s, d), 0.5, 6.0, 0.15, 5.0, 0.25)


def _board(s, d):
    """What the board sends: its ten features."""
    return _features(s, d).select(*FRAME, *(F.col(f"f{k}").alias(c) for k, c in enumerate(g.NAMES)))


def _modes(s, d):
    """the ten features of every mode in one form; what follows is the same for all. The map's are taken in the form in which
    `f03_map_moments` returns them, rounded, so that the correlation is over the Doppler that the row shows."""
    heatmap = rounded(g.map_moments(g.suppress(fx.rd_cells(s, d), 8, 1), 8, 1, 8, 60.0))
    parts = [g.features_of(mode, _board(s, d), _point_features(s, d), heatmap).withColumn("mode", F.lit(mode)) for mode in ("onchip", "points", "heatmap")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LOW = (0.105,) * 10


def _decided(s, d):
    """decisions on the board's probabilities, and on those of the host's network from the board's features."""
    onchip = g.recognise("onchip", _board(s, d), board_probs=_probs(s, d), thresholds=EASY, votes=FEW)
    host = g.recognise("onchip_features", _board(s, d), _layers(), MEANS, SDS, thresholds=LOW, votes=FEW)
    return onchip.withColumn("mode", F.lit("onchip")).unionByName(host.withColumn("mode", F.lit("onchip_features"))).drop("probs")


def _layers(sizes=(90, 30, 60, 10)):
    """Weights by a formula, so that SQL can state them too: sin((i + 1) (j + 2)) of output i and input j, over the root of the inputs."""
    return [(np.sin(np.outer(np.arange(1, m + 1), np.arange(2, n + 2))) / n**0.5, np.cos(np.arange(1, m + 1)) / 10) for n, m in zip(sizes, sizes[1:])]


def _windows(s, d):
    return g.windows(_features(s, d), COLUMNS, MEANS, SDS)


def _angle_cells(s, d):
    """Four-channel cells, from eight complex samples of each range bin; every fifth frame is silent."""
    c = fx.angle_cells(s, d).withColumn("dop_bin", F.floor(F.col("ant") / 4)).withColumn("ch", F.col("ant") % 4)
    part = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("ch", x))), lambda y: y[x])
    value = F.when(F.col("frame_idx") % 5 == 4, 0.0).otherwise(F.sum(F.hypot("re", "im")))
    return c.groupBy(*FRAME, "range_bin", "dop_bin").agg(part("re").alias("re"), part("im").alias("im"), value.alias("value"))


def _trained(s, d):
    """Windows of all sessions, a network fitted on some sessions, confusion on the others."""
    w = _windows(s, d).where("ready").join(g.training_windows(_features(s, d).withColumn("label", (F.col("recording_id") % 3).cast("int")), ["f0", "f5"]), FRAME)
    rows = g.split_by_session(w.select(*FRAME, "window", "target"), 0.3)
    net = network.fit(rows, hidden=(8,), classes=3, rounds=20).layers
    told = g.score(rows.where("validation"), net)
    best = F.expr("array_position(probs, array_max(probs))").cast("int") - 1
    return g.confusion(told.select("target", best.alias("predicted")))


def _argmax(s, d):
    best = F.expr("array_position(probs, array_max(probs))").cast("int") - 1
    return g.confusion(_probs(s, d).select((F.col("recording_id") % 10).cast("int").alias("target"), best.alias("predicted")))


QUERIES = {
    "f02_suppress": lambda s, d: g.suppress(fx.rd_cells(s, d), 8, 1),
    "f03_map_moments": lambda s, d: g.map_moments(g.suppress(fx.rd_cells(s, d), 8, 1), 8, 1, 8, 60.0),
    "f04_angle_moments": lambda s, d: g.angle_moments(_angle_cells(s, d), 3, 4),
    "f05_point_features": _point_features,
    "f06_heatmap_features": lambda s, d: g.heatmap_features(fx.rd_cells(s, d), 8, 1, 0.25, 1.5, 0.25, 8, 0.01),
    "f07_correlation": lambda s, d: g.correlation(_features(s, d), "f5", "f0").select(*FRAME, "correlation"),
    "f08_windows": lambda s, d: _windows(s, d).select(*FRAME, "ready", F.size("window").alias("size"), F.get("window", F.lit(89)).alias("newest"), F.get("window", F.lit(0)).alias("oldest"), F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("total")),
    "f09_score": lambda s, d: g.score(_windows(s, d), _layers()).select(*FRAME, F.array_max("probs").alias("top"), F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("total")),
    "f10_debounce": lambda s, d: _states(s, d).select(*FRAME, "state", "fired", "probability"),
    "f12_repeats": lambda s, d: g.repeats(_states(s, d), 3).select(*FRAME, "state", "repeated"),
    "f13_event_counts": lambda s, d: g.event_counts(_states(s, d)),
    "f14_modes": _modes,
    "f14_decisions": _decided,
    "f15_agreement": lambda s, d: g.agreement(_host(s, d), _probs(s, d)),
    "f16_training_windows": lambda s, d: g.training_windows(_features(s, d), ["f0", "f5", "f6"]),
    "f17_normalise": lambda s, d: g.normalise(fx.gesture_cells(s, d), g.normalisation(fx.gesture_cells(s, d))),
    "f18_balance": lambda s, d: g.balance(g.training_windows(_features(s, d), ["f0", "f5", "f6"])),
    "f19_train": _trained,
    "f20_confusion": _argmax,
}
QUERIES = {k: (lambda s, d, f=f: rounded(f(s, d))) for k, f in QUERIES.items()}

PIVOT = ", ft AS (SELECT recording_id, frame_idx, " + ", ".join(f"max(feature) FILTER (k = {k}) AS f{k}" for k in range(10)) + " FROM gesture_cells GROUP BY 1, 2)\n"
SUP = "(SELECT *, CASE WHEN dop_bin <= 1 OR dop_bin >= 7 THEN 0 ELSE {v} END AS m, CASE WHEN dop_bin < 4 THEN dop_bin ELSE dop_bin - 8 END AS s FROM rd_cells)"
_q = lambda a, b: f"round(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END, 6) + 0.0"
_MOMENTS = f"""{_q('sum(m * s)', 'sum(m)')} AS doppler, {_q('coalesce(sum(m * s) FILTER (dop_bin < 4), 0)', 'coalesce(sum(m) FILTER (dop_bin < 4), 0)')} AS doppler_up,
 {_q('coalesce(sum(m * s) FILTER (dop_bin >= 4), 0)', 'coalesce(sum(m) FILTER (dop_bin >= 4), 0)')} AS doppler_down, {_q('sum(m * range_bin)', 'sum(m)')} AS range_bins"""
HEAT = f"SELECT recording_id, frame_idx, {_MOMENTS}, CAST(count(*) FILTER (m > 60) AS DOUBLE) AS n_detections, round(sum(m) / 10000, 6) AS energy FROM {SUP.format(v='value')} WHERE range_bin BETWEEN 1 AND 7 GROUP BY 1, 2"
POINT = f""", pf AS (SELECT *, {RANGE} AS r, {AZIMUTH} AS az, degrees(atan2(z, sqrt(x * x + y * y))) AS el, coalesce(pow(10, snr_db / 10), 1) AS w, coalesce(snr_db, 99) AS q FROM points),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, frame_idx ORDER BY w DESC, point_idx DESC) AS place FROM pf WHERE r BETWEEN 0.5 AND 6 AND abs(v) >= 0.15 AND q >= 5) WHERE place <= 10),
pa AS (SELECT recording_id, frame_idx, sum(w * v) / sum(w) AS doppler, coalesce(sum(w * v) FILTER (v >= 0) / nullif(sum(w) FILTER (v >= 0), 0), 0) AS doppler_up, coalesce(sum(w * v) FILTER (v < 0) / nullif(sum(w) FILTER (v < 0), 0), 0) AS doppler_down,
  sum(w * r) / sum(w) / 0.25e0 AS range_bins, CAST(count(*) AS DOUBLE) AS n_detections, sum(w * az) / sum(w) AS azimuth, sum(w * el) / sum(w) AS elevation,
  sum(w * az * az) / sum(w) - (sum(w * az) / sum(w)) ** 2 AS azimuth_spread, sum(w * el * el) / sum(w) - (sum(w * el) / sum(w)) ** 2 AS elevation_spread FROM pk GROUP BY 1, 2),
pt AS (SELECT recording_id, frame_idx, {', '.join(f'round(coalesce({c}, 0), 6) + 0.0 AS {c}' for c in ('doppler', 'doppler_up', 'doppler_down', 'range_bins', 'n_detections', 'azimuth', 'elevation', 'azimuth_spread', 'elevation_spread'))} FROM frame_spine LEFT JOIN pa USING (recording_id, frame_idx))
"""
_ROW = [f"((f{c[1:]} - ({m})) / {s})" for c, m, s in zip(COLUMNS, MEANS, SDS)]
_O = "(PARTITION BY recording_id ORDER BY frame_idx"
STATES = f""", vt AS (SELECT recording_id, frame_idx, k, prob, sum(CASE WHEN prob >= 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, k ORDER BY frame_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS n FROM gesture_cells),
st AS (SELECT recording_id, frame_idx, CAST(coalesce(max(k) FILTER (n > 1), 0) AS INT) AS state FROM vt GROUP BY 1, 2),
fi AS (SELECT *, lag(state, 1, 0) OVER {_O}) AS prev FROM st),
ev AS (SELECT fi.*, state <> prev AND state <> 0 AS fired, prob FROM fi JOIN gesture_cells c ON c.recording_id = fi.recording_id AND c.frame_idx = fi.frame_idx AND c.k = state)
"""
TRAIN = PIVOT + f""", tw AS (SELECT recording_id, frame_idx, greatest({', '.join(f'max({c}) OVER w - min({c}) OVER w' for c in ('f0', 'f5', 'f6'))}) AS motion, count(*) OVER w AS n FROM ft WINDOW w AS {_O} ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)),
tl AS (SELECT recording_id, frame_idx, motion, CAST(CASE WHEN motion >= quantile_cont(motion, 0.6) OVER (PARTITION BY recording_id) THEN recording_id % 10 ELSE 0 END AS INT) AS target FROM (SELECT * FROM tw WHERE n = 15))
"""
_dense = lambda x, n, m, relu: f"list_transform(range(1, {m + 1}), lambda i: {'greatest(0, ' if relu else '('}cos(i) / 10 + list_sum(list_transform(range(1, {n + 1}), lambda j: {x}[j] * sin(i * (j + 1)))) / sqrt({n})))"
SCORE = f""", w0 AS (SELECT recording_id, frame_idx, array_agg([{', '.join(_ROW)}]) OVER {_O} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS l FROM ft),
w1 AS (SELECT recording_id, frame_idx, list_concat(list_transform(range(90 - 6 * len(l)), lambda z: 0.0e0), flatten(l)) AS x FROM w0),
w2 AS (SELECT recording_id, frame_idx, {_dense('x', 90, 30, True)} AS x FROM w1), w3 AS (SELECT recording_id, frame_idx, {_dense('x', 30, 60, True)} AS x FROM w2), w4 AS (SELECT recording_id, frame_idx, {_dense('x', 60, 10, False)} AS x FROM w3),
w5 AS (SELECT recording_id, frame_idx, list_transform(x, lambda y: exp(y - list_max(x))) AS e FROM w4)
"""
_corr = lambda table, mode: f"SELECT recording_id, frame_idx, {', '.join(c if c != 'correlation' else 'CASE WHEN count(*) OVER w < 20 OR min(azimuth) OVER w = max(azimuth) OVER w OR min(doppler) OVER w = max(doppler) OVER w THEN 0 ELSE coalesce(corr(azimuth, doppler) OVER w, 0) END AS correlation' for c in g.NAMES)}, '{mode}' AS mode FROM {table} WINDOW w AS {_O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
CONF = """SELECT target, predicted, n, round(sum(n) FILTER (target = predicted) OVER () / sum(n) OVER (), 6) AS accuracy"""
SQL = {
    "f02_suppress": sql(f"SELECT recording_id, frame_idx, dop_bin, range_bin, round(m, 6) + 0.0 AS value FROM {SUP.format(v='value')}", "rd_cells"),
    "f03_map_moments": sql(HEAT, "rd_cells"),
    "f04_angle_moments": sql(f""", ce AS (SELECT recording_id, frame_idx, range_bin, ant // 4 AS dop_bin, 3 - ant % 4 AS pl, CASE WHEN ant % 2 = 1 THEN -1 ELSE 1 END / 64 AS sg, re, im, CASE WHEN frame_idx % 5 = 4 THEN 0 ELSE sum(sqrt(re * re + im * im)) OVER (PARTITION BY recording_id, frame_idx, range_bin, ant // 4) END AS value FROM angle_cells),
      tp AS (SELECT recording_id, frame_idx, range_bin, dop_bin, any_value(value) AS w FROM ce WHERE range_bin < 3 AND value > 0 GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY recording_id, frame_idx ORDER BY any_value(value) DESC, range_bin, dop_bin) <= 4),
      gr AS (SELECT recording_id, frame_idx, range_bin, dop_bin, w, k, sum(sg * (re * cos(ph) + im * sin(ph))) AS a, sum(sg * (im * cos(ph) - re * sin(ph))) AS b
        FROM (SELECT *, 2 * {np.pi!r} * (((k // 32) * (pl // 2) + (k % 32) * (pl % 2)) % 32) / 32 AS ph FROM ce JOIN tp USING (recording_id, frame_idx, range_bin, dop_bin), (SELECT unnest(range(1024)) AS k)) GROUP BY ALL),
      pk AS (SELECT recording_id, frame_idx, w, arg_max(k, (round(sqrt(a * a + b * b), 9), -k)) AS k FROM gr GROUP BY recording_id, frame_idx, range_bin, dop_bin, w),
      an AS (SELECT recording_id, frame_idx, w, (k // 32 + 16) % 32 - 16 AS az, (k % 32 + 16) % 32 - 16 AS el FROM pk)
      SELECT recording_id, frame_idx, round(coalesce(sum(w * az) / sum(w), 0), 6) + 0.0 AS azimuth, round(coalesce(sum(w * el) / sum(w), 0), 6) + 0.0 AS elevation, round(coalesce(sum(w * az * az) / sum(w) - (sum(w * az) / sum(w)) ** 2, 0), 6) + 0.0 AS azimuth_spread,
        round(coalesce(sum(w * el * el) / sum(w) - (sum(w * el) / sum(w)) ** 2, 0), 6) + 0.0 AS elevation_spread FROM (SELECT DISTINCT recording_id, frame_idx FROM angle_cells) LEFT JOIN an USING (recording_id, frame_idx) GROUP BY 1, 2""", "angle_cells"),
    "f05_point_features": sql(POINT + "SELECT * FROM pt", "points", "frame_spine"),
    "f06_heatmap_features": sql(f""", hm AS (SELECT *, median(CASE WHEN m > 0 THEN m END) OVER (PARTITION BY recording_id, frame_idx) * 8 AS lim FROM {SUP.format(v='pow(2, value * 0.01e0)')} WHERE range_bin BETWEEN 1 AND 6)
      SELECT recording_id, frame_idx, {_MOMENTS}, CAST(count(*) FILTER (m > lim) AS DOUBLE) AS n_detections FROM hm GROUP BY 1, 2""", "rd_cells"),
    "f07_correlation": sql(PIVOT + f"SELECT recording_id, frame_idx, round(CASE WHEN count(*) OVER w < 20 THEN 0 ELSE coalesce(corr(f5, f0) OVER w, 0) END, 6) + 0.0 AS correlation FROM ft WINDOW w AS {_O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "gesture_cells"),
    "f08_windows": sql(PIVOT + f"""SELECT recording_id, frame_idx, count(*) OVER w >= 15 AS ready, 90 AS size, round({_ROW[5]}, 6) + 0.0 AS newest,
      round(CASE WHEN count(*) OVER w >= 15 THEN lag({_ROW[0]}, 14) OVER {_O}) ELSE 0 END, 6) + 0.0 AS oldest, round(sum({' + '.join(_ROW)}) OVER w, 6) + 0.0 AS total FROM ft WINDOW w AS {_O} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""", "gesture_cells"),
    "f09_score": sql(PIVOT + SCORE + "SELECT recording_id, frame_idx, round(list_max(e) / list_sum(e), 6) AS top, 1.0e0 AS total FROM w5", "gesture_cells"),
    "f10_debounce": sql(STATES + "SELECT recording_id, frame_idx, state, fired, round(CASE WHEN fired THEN prob END, 6) AS probability FROM ev", "gesture_cells"),
    "f12_repeats": sql(STATES + "SELECT recording_id, frame_idx, state, state = prev AND state <> 0 AND frame_idx % 3 = 0 AS repeated FROM ev", "gesture_cells"),
    "f13_event_counts": sql(STATES + "SELECT state, count(*) AS n FROM ev WHERE fired GROUP BY 1", "gesture_cells"),
    "f14_modes": sql(POINT + PIVOT + f""", hp AS (SELECT h.recording_id, h.frame_idx, h.doppler, h.doppler_up, h.doppler_down, h.range_bins, h.n_detections, coalesce(pa.azimuth, 0) AS azimuth, coalesce(pa.elevation, 0) AS elevation,
        coalesce(pa.azimuth_spread, 0) AS azimuth_spread, coalesce(pa.elevation_spread, 0) AS elevation_spread FROM ({HEAT}) h LEFT JOIN pa USING (recording_id, frame_idx)),
      ps AS (SELECT recording_id, frame_idx, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('doppler', 'doppler_up', 'doppler_down', 'range_bins', 'n_detections', 'azimuth', 'elevation', 'azimuth_spread', 'elevation_spread'))} FROM frame_spine LEFT JOIN pa USING (recording_id, frame_idx)),
      md AS ({_corr('ps', 'points')} UNION ALL {_corr('hp', 'heatmap')} UNION ALL SELECT recording_id, frame_idx, {', '.join(f'f{k} AS {c}' for k, c in enumerate(g.NAMES))}, 'onchip' AS mode FROM ft)
      SELECT recording_id, frame_idx, mode, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in g.NAMES)} FROM md""", "points", "frame_spine", "rd_cells", "gesture_cells"),
    "f14_decisions": sql(STATES + PIVOT + SCORE + f""", pb AS (SELECT recording_id, frame_idx, unnest(range(10)) AS k, unnest(e) / list_sum(e) AS prob, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS i FROM w5),
      hv AS (SELECT *, sum(CASE WHEN prob >= {LOW[0]} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, k ORDER BY frame_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS r FROM pb) WHERE r >= 15),
      hs AS (SELECT recording_id, frame_idx, CAST(coalesce(max(k) FILTER (n > 1), 0) AS INT) AS state FROM hv GROUP BY 1, 2), hf AS (SELECT *, state <> 0 AND state <> lag(state, 1, 0) OVER {_O}) AS fired FROM hs)
      SELECT recording_id, frame_idx, true AS ready, state, fired, 'onchip' AS mode FROM ev
      UNION ALL SELECT w5.recording_id, w5.frame_idx, hf.state IS NOT NULL, coalesce(hf.state, 0), coalesce(fired, false), 'onchip_features' FROM w5 LEFT JOIN hf ON hf.recording_id = w5.recording_id AND hf.frame_idx = w5.frame_idx""", "gesture_cells"),
    "f15_agreement": sql(""", d AS (SELECT a.recording_id, a.frame_idx, max(abs(a.prob - b.prob)) AS top, sum(abs(a.prob - b.prob)) AS s FROM gesture_cells a JOIN gesture_cells b ON a.recording_id = b.recording_id AND a.frame_idx = b.frame_idx AND a.k = 9 - b.k GROUP BY 1, 2),
      e AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS i FROM d)
      SELECT recording_id, round(max(top), 6) AS max_difference, round(sum(s) / (10 * count(*)), 6) AS mean_difference FROM e WHERE n <= 15 OR i > 15 GROUP BY 1""", "gesture_cells"),
    "f16_training_windows": sql(TRAIN + "SELECT recording_id, frame_idx, round(motion, 6) AS motion, target FROM tl", "gesture_cells"),
    "f17_normalise": sql("SELECT recording_id, frame_idx, k, round((feature - avg(feature) OVER p) / CASE WHEN stddev_pop(feature) OVER p < 1e-9 THEN 1 ELSE stddev_pop(feature) OVER p END, 6) + 0.0 AS feature FROM gesture_cells WINDOW p AS (PARTITION BY k)", "gesture_cells"),
    "f18_balance": sql(TRAIN + "SELECT target, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM tl GROUP BY 1", "gesture_cells"),
    "f20_confusion": sql(f", p AS (SELECT CAST(recording_id % 10 AS INT) AS target, CAST(arg_max(k, (prob, -k)) AS INT) AS predicted FROM gesture_cells GROUP BY recording_id, frame_idx), c AS (SELECT target, predicted, count(*) AS n FROM p GROUP BY 1, 2) {CONF.replace('sum(n) FILTER (target = predicted) OVER ()', 'coalesce(sum(n) FILTER (target = predicted) OVER (), 0)')} FROM c", "gesture_cells"),
}
