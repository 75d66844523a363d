"""Queries S and L with their SQL: captures, configurations and streams that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dopplerlake.functions.scalars import rounded
from dopplerlake.operators import audit as a
from dopplerlake.operators import gait as g_
from dopplerlake.operators import ghosts as h
from dopplerlake.operators import maps as m
from dopplerlake.operators import points as p
from dopplerlake.operators import tracking as t
from dopplerlake.plans.gestures import EASY, FEW, STATES, _features, _probs
from dopplerlake.plans.maps import FEATURES, TRACKS
from dopplerlake.plans.points import PAYLOADS, TARGET, _payload_frames, _tracks
from dopplerlake.plans.series import FOLLOW_TWO, SPECTRUM, WALK, _metrics
from dopplerlake.plans.session import shared_folder
from dopplerlake.sources import captures as c
from dopplerlake.sources import fixture_captures as fc
from dopplerlake.sources import fixtures as fx
from dopplerlake.sources import manifest as mf
from dopplerlake.sources.fixtures import sql
from dopplerlake.sources.wire import MAGIC
from dopplerlake.streaming import apps
from dopplerlake.streaming import stateful as st
from dopplerlake.streaming.fold import run_stream, staged

FRAME = ["recording_id", "frame_idx"]


def _packets(s, d):
    return fc.encode(p.nest(fx.points(s, d)))


def _pieces(s, d, size=1 << 16):
    return fc.as_pieces(_packets(s, d), size)


def _monitor(s, d):
    k = F.col("p_partkey")
    return fx.table(s, d, "part").select(k.alias("cfg_id"), (k % 3).alias("objects"), *((F.floor(k / n) % 2).alias(c_) for n, c_ in ((2, "profile"), (3, "noise"), (5, "azimuth_map"), (7, "doppler_map"), (11, "stats"))))


def _files(s, d):
    """A file list from the order table: a capture an order, a configuration beside most."""
    o = fx.table(s, d, "orders")
    run = F.concat(F.lit("/data/site"), F.pmod("o_custkey", F.lit(50)).cast("string"), F.when(F.col("o_orderkey") % 9 == 0, "/empty_room_").otherwise("/run_"), F.col("o_orderkey").cast("string"))
    name = F.explode(F.array_compact(F.array(F.lit("a.dat"), F.when(F.col("o_orderkey") % 4 != 0, "a.cfg"), F.when(F.col("o_orderkey") % 13 == 0, "b.dat"))))
    return o.select(run.alias("dir"), F.unix_timestamp("o_orderdate").alias("modified_at"), name.alias("name"))


def _stream(s, d, name):
    # a glob, since the table may be one file or a folder
    schema = fx.table(s, d, name).schema
    return s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parq*")


def _staged(s, df, order, name, **k):
    """A table as a stream source: written to the shared folder in several pieces, read back over several micro-batches."""
    return staged(df, order, f"{shared_folder(s)}/{_unique(name)}", **k)


def _chunks(s, d):
    """Captures in chunks of 1000 bytes, ten a second."""
    return _pieces(s, d, 1000).withColumn("ts", 100 + F.col("seq") / 10)


def _unique(name):
    import uuid

    return f"{name}-{uuid.uuid4().hex}"


def _candidates(s, d, targets=1):
    return fx.frame_spine(s, d).select(*FRAME).join(t.strongest_candidates(fx.points(s, d), targets, 0.15), FRAME, "left")


def _walks(s, d):
    return g_.smooth(fx.envelope(s, d)).select(*FRAME, "t", "v")


def _damaged(s, d):
    """Captures that begin in a packet, hold a magic word without a packet behind it, and end in a packet."""
    head, tail = bytes([7]) * 13 + MAGIC + bytes(40), MAGIC + bytes(4) + (64).to_bytes(4, "little") + bytes(34)
    return fc.as_pieces(_packets(s, d), 1 << 12, head, tail)


def _index(s, d, part):
    """L2: the captures as a stream of chunks into raw packets and their index."""
    folder = f"{shared_folder(s)}/{_unique('pair')}"
    return st.dual_sink(st.reassemble(_staged(s, _chunks(s, d), "seq", "chunks")), folder)[part]


def _reports(s, d):
    """What recordings report: sign-ups without bytes, and errors of the reader."""
    e = fx.table(s, d, "events")
    kind = F.col("event_type")
    return e.select(F.col("user_id").alias("recording_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(kind.isin("signup", "error"), 0).otherwise(F.ceil("value")).cast("long").alias("n_bytes"), (kind == "error").alias("failed"))


#: Seconds of silence in the query; reports are hours apart.
SILENCE = 20 * 3600


def _health(s, d):
    told = st.health(_staged(s, _reports(s, d).withColumn("at", F.unix_micros("ts").cast("double")), "at", "reports", key=None), SILENCE)
    return st.replay(told, shared_folder(s))


def _counters(s, d):
    """The counts as they stand after each micro-batch of a stream of frames, the last of them."""
    folder = f"{shared_folder(s)}/{_unique('counters')}"
    frames = _staged(s, fx.audit_frames(s, d).select(*FRAME, "num_points", "skipped_before"), "frame_idx", "frames")
    return st.latest_counters(st.running_counters(frames, folder))


def _axes(s, d):
    """Axes of the configurations; the bias of the range axis is a centimetre for each unit of the id."""
    cfg = c.parse_configs(fc.config_lines(s, d)).withColumns({"range_bias": F.col("cfg_id") % 10 * 0.01, "velocity_bins": F.col("loops").cast("long")})
    return m.axes(cfg)


def _payloads(s, d):
    """Every payload type but points, encoded into packets, told apart again and decoded: one row a number."""
    packets = fc.encode_dense(fx.dense_frames(s, d))
    kinds = (2, 3, 4, 5, 6, 8, 9, 1050, 1051)
    p = c.decode(c.shred(packets), kinds, {2: 64, 3: 64, 4: 32, 5: 60, 8: 32})
    plain = lambda name: F.transform(name, lambda x: x.cast("double"))
    parts = lambda name: F.flatten(F.transform(name, lambda x: F.array(x["re"], x["im"])))
    fields = lambda kind: F.array(*(F.col(f"{c.RECORDS[kind][0]}.{f}").cast("double") for f in c.RECORDS[kind][2]))
    values = {2: plain("range_profile"), 3: plain("noise_profile"), 4: parts("azimuth_iq"), 5: plain("range_doppler"), 6: fields(6), 8: parts("antenna_iq"), 9: fields(9), 1050: plain("gesture_features"), 1051: plain("gesture_probs")}
    each = F.array(*(F.struct(F.lit(k).alias("tlv"), v.alias("v")) for k, v in values.items()))
    rows = p.select(*FRAME, F.array_join("anomalies", "; ").alias("anomalies"), F.explode(each).alias("e"))
    return rows.select(*FRAME, "anomalies", "e.tlv", F.posexplode("e.v").alias("pos", "value"))


def _sessions(s, d):
    """raw features of labelled recordings, written by label and read back for three labels only."""
    f = _features(s, d)
    path = c.write_sessions(f.withColumn("t", F.col("frame_idx") * 0.035), "label", f"{shared_folder(s)}/{_unique('sessions')}")
    return c.read_sessions(s, path, f.schema, "label", [1, 4, 7]).select(*FRAME, "label", "t", "f0", "f9")


def _decoded(s, d):
    return p.flatten(c.decode(c.shred(c.cut(_pieces(s, d)))))


def _frame_counts(s, d):
    """What a manifest says of points, by frame: points that each method tags, and the range of the target. One pass over the points,
    written to the shared folder, since two parts of the manifest need it."""
    points = h.features(p.ranked(fx.points(s, d, by=("recording_id",))), 0.25, 0.5)
    rows = points.groupBy(*FRAME).agg(*h.tag_counts(0.5), F.max(F.when(F.expr(f"place = 1 and {TARGET}"), F.col("range_m"))).alias("range_m"))
    path = f"{shared_folder(s)}/{_unique('frame-counts')}"
    rows.write.parquet(path)
    return s.read.schema(rows.schema).parquet(path)


def _manifest(s, d):
    """Manifests of all recordings and ghost methods, written by bucket and read back."""
    frames = fx.audit_frames(s, d)
    cfg = c.parse_configs(fc.config_lines(s, d)).withColumnRenamed("cfg_id", "recording_id")
    geometry = cfg.select("recording_id", "range_bins", "range_spacing", "velocity_spacing", "max_velocity", "fps", "n_virtual")
    # thresholds as the configuration allows: no step slower than a velocity bin, no region beyond the last range bin
    parameters = cfg.select("recording_id", F.greatest(F.lit(0.2), "velocity_spacing").alias("v_min"), F.least(F.lit(8.0), F.col("range_bins") * F.col("range_spacing")).alias("far_m"))
    found = _frame_counts(s, d)
    rows = mf.manifest(
        a.summary(frames).drop("fps"), a.anomaly_counts(frames), a.availability(_payload_frames(s, d)), geometry, _metrics(s, d), g_.spectral_cadence(fx.envelope(s, d), 0.2, 0.5, 2.4), h.tagged_of(found),
        a.track_quality(_tracks(s, d, found.select(*FRAME, "range_m"))), parameters,
    )
    path = mf.write_manifest(rows, f"{shared_folder(s)}/{_unique('manifest')}")
    read = mf.read_manifest(s, path, rows.schema)
    return read.select(*mf.flat(read))


QUERIES = {
    "s01_packets": lambda s, d: c.cut(_pieces(s, d)).select(*FRAME, "byte_offset", "skipped_before", F.octet_length("packet").cast("long").alias("length")),
    "s02_points_decoded": _decoded,
    "s02_payloads": _payloads,
    "a01_bytes": lambda s, d: c.accounting(_damaged(s, d)),
    "f21_sessions": _sessions,
    "s03_header": lambda s, d: c.header(c.cut(_pieces(s, d))).select(*FRAME, "frame_number", "num_obj", "num_tlvs", "sdk", "device"),
    "s04_configs": lambda s, d: c.parse_configs(fc.config_lines(s, d)).select(
        "cfg_id", "n_tx", "n_virtual", "range_bins", "loops", "start_actual", "slope_actual", "centre_ghz", "range_spacing", "max_velocity", "velocity_spacing", "fps", "log_to_linear", "bins_per_db",
        "compensation", "compensation_db", F.array_join(F.transform("slots", lambda x: x.cast("string")), ",").alias("slots"), F.array_join("unread", ",").alias("unread"), F.array_join("warnings", ",").alias("warnings"),
    ),
    "s05_expected_tlvs": lambda s, d: c.expected_tlvs(_monitor(s, d)).select("cfg_id", "expected"),
    "s06_runs": lambda s, d: c.find_runs(_files(s, d), ["default.cfg"]),
    "s07_latest": lambda s, d: c.latest(_files(s, d)),
    "s08_background_runs": lambda s, d: c.background_runs(c.find_runs(_files(s, d), ["default.cfg"])),
    "s09_manifest": _manifest,
    "s10_in_order": lambda s, d: c.in_order([fx.frame_spine(s, d).where("frame_idx < 50"), fx.frame_spine(s, d).where("frame_idx >= 50")]).select(*FRAME, "part"),
    "m13_axes": _axes,
    "l01_reassemble": lambda s, d: st.replay(st.reassemble(_staged(s, _chunks(s, d), "seq", "chunks")), shared_folder(s)).drop("packet"),
    "l02_raw": lambda s, d: _index(s, d, 0).select(*FRAME, "byte_offset", F.octet_length("packet").cast("long").alias("length")),
    "l02_index": lambda s, d: _index(s, d, 1).withColumns({"tlvs": F.array_join(F.col("tlvs").cast("array<string>"), ","), "anom": F.array_join("anom", "; ")}),
    "l03_stream_gate": lambda s, d: st.replay(_stream(s, d, "lineitem").where("l_quantity >= 25").select(F.col("l_suppkey").alias("recording_id"), (F.col("l_partkey") % 100).alias("frame_idx"), "l_quantity"), shared_folder(s)),
    "l03_walking": lambda s, d: st.replay(run_stream(apps.walking(), _staged(s, _walks(s, d), "frame_idx", "walks")), shared_folder(s)),
    "l04_decisions": lambda s, d: st.replay(st.online_decisions(_staged(s, _probs(s, d), "frame_idx", "probs"), EASY, FEW), shared_folder(s)),
    "l04_correlation": lambda s, d: st.replay(st.online_correlation(_staged(s, _features(s, d).select(*FRAME, F.col("f5").alias("azimuth"), F.col("f0").alias("doppler")), "frame_idx", "features")), shared_folder(s)),
    "l05_health": _health,
    "l06_counters": _counters,
    "l07_track": lambda s, d: st.replay(st.online_track(_staged(s, _candidates(s, d, 2), "frame_idx", "candidates"), 2), shared_folder(s)),
}
QUERIES = {k: (lambda s, d, f=f: rounded(f(s, d))) for k, f in QUERIES.items()}

SIZES = """, fr AS (SELECT recording_id, frame_idx, count(*) AS n FROM points GROUP BY 1, 2),
pk AS (SELECT *, CAST(ceil((40 + 16 + n * 20) / 32.0) * 32 AS BIGINT) AS length, CASE WHEN frame_idx % 10 = 3 THEN 5 ELSE 0 END AS gap, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - 1 AS i FROM fr),
po AS (SELECT *, CAST(sum(length + gap) OVER (PARTITION BY recording_id ORDER BY i) - length AS BIGINT) AS byte_offset FROM pk)
"""
PACKETS = "SELECT recording_id, i AS frame_idx, byte_offset, CAST(gap AS BIGINT) AS skipped_before, length FROM po"
FILES = ", fl AS (SELECT '/data/site' || (o_custkey % 50) || CASE WHEN o_orderkey % 9 = 0 THEN '/empty_room_' ELSE '/run_' END || o_orderkey AS dir, CAST(epoch(o_orderdate) AS BIGINT) AS modified_at, o_orderkey AS o FROM orders)\n"
_files_sql = lambda body: "WITH " + FILES[2:] + body
_K = "p_partkey"
CONFIGS = """WITH a AS (
      SELECT p_partkey AS k, bit_count(p_partkey % 7 + 1) AS tx, pow(2, ceil(log2(p_partkey % 200 + 65))) AS bins, p_partkey % 200 + 65 AS samples, p_partkey % 5000 + 2000 AS ksps, p_partkey % 64 + 16 AS loops,
        (p_partkey % 50 + 7 + p_partkey % 30 + 24) * 1e-6 AS chirp, 2.7e0 / 67108864 AS unit, p_partkey % 4 + 60 AS start_ghz, CAST((p_partkey % 60 + 20) || '.013' AS DOUBLE) AS slope FROM part),
    b AS (SELECT *, floor(start_ghz / unit) * unit AS start_actual, floor(slope / unit) * unit AS slope_actual FROM a),
    c AS (SELECT *, start_actual + 0.5e0 * slope_actual * samples / ksps + slope_actual * 3 * 1e-8 AS centre FROM b)
"""
SQL = {
    "s01_packets": sql(SIZES + PACKETS, "points"),
    "s02_points_decoded": sql(SIZES + """SELECT p.recording_id, i AS frame_idx, point_idx, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(v AS FLOAT) AS v, round(round_even(coalesce(snr_db, 0) * 10, 0) / 10, 6) + 0.0 AS snr_db, round(round_even(coalesce(noise_db, 0) * 10, 0) / 10, 6) + 0.0 AS noise_db
      FROM points p JOIN po USING (recording_id, frame_idx)""", "points"),
    "s02_payloads": sql(""", ce AS (SELECT recording_id, frame_idx, pos, val, lead(val, CAST(63 - 2 * pos AS INT)) OVER w AS later, lag(val, CAST(2 * pos - 63 AS INT)) OVER w AS earlier FROM emb_cells WINDOW w AS (PARTITION BY recording_id, frame_idx ORDER BY pos)),
      fr AS (SELECT DISTINCT recording_id, frame_idx AS f FROM emb_cells),
      al AS (
        SELECT recording_id, frame_idx, unnest([2, 5]) AS tlv, pos, floor(abs(val) * 1000) AS value FROM ce
        UNION ALL SELECT recording_id, frame_idx, 3, pos, floor(abs(CASE WHEN pos < 32 THEN later ELSE earlier END) * 1000) FROM ce
        UNION ALL SELECT recording_id, frame_idx, unnest([4, 8]), pos, floor(val * 1000) FROM ce
        UNION ALL SELECT recording_id, f, 6, unnest(range(6)), unnest([f, 2, f * 3, 4, f % 100, 6]) FROM fr
        UNION ALL SELECT recording_id, f, 9, unnest(range(12)), unnest([0, f * 40, 20 + f % 7, 19 + f % 7, 18 + f % 7, 17 + f % 7, 16 + f % 7, 15 + f % 7, 14 + f % 7, 13 + f % 7, 12 + f % 7, 11 + f % 7]) FROM fr
        UNION ALL SELECT recording_id, frame_idx, 1050, pos, CAST(CAST(val * 10 AS FLOAT) AS DOUBLE) FROM ce WHERE pos < 10
        UNION ALL SELECT recording_id, frame_idx, 1051, pos - 10, CAST(CAST(val AS FLOAT) AS DOUBLE) FROM ce WHERE pos BETWEEN 10 AND 19)
      SELECT recording_id, frame_idx, 'range_doppler_size_mismatch (expected 60, got 64)' AS anomalies, CAST(tlv AS INT) AS tlv, CAST(pos AS INT) AS pos, round(value, 6) + 0.0 AS value FROM al""", "emb_cells"),
    "a01_bytes": sql(SIZES + """SELECT recording_id, CAST(sum(length + gap) + 13 + 48 + 50 AS BIGINT) AS bytes_total, CAST(sum(length) AS BIGINT) AS bytes_in_frames, CAST(sum(gap) + 61 AS BIGINT) AS bytes_skipped, CAST(50 AS BIGINT) AS truncated_tail,
      CAST(13 AS BIGINT) AS leading_partial, count(*) FILTER (gap > 0 AND i > 0) + 1 AS resyncs, CAST(1 AS BIGINT) AS false_magics, count(*) FILTER (length > 56 + n * 20) AS padded_frames, CAST(sum(length - 56 - n * 20) AS BIGINT) AS padding_bytes, CAST(0 AS BIGINT) AS anomalous_frames FROM po GROUP BY 1""", "points"),
    "f21_sessions": sql(""", ft AS (SELECT recording_id, frame_idx, max(feature) FILTER (k = 0) AS f0, max(feature) FILTER (k = 9) AS f9 FROM gesture_cells GROUP BY 1, 2)
      SELECT recording_id, frame_idx, CAST(recording_id % 10 AS INT) AS label, round((frame_idx - min(frame_idx) OVER (PARTITION BY recording_id)) * 0.035e0, 6) + 0.0 AS t, round(f0, 6) + 0.0 AS f0, round(f9, 6) + 0.0 AS f9 FROM ft WHERE recording_id % 10 IN (1, 4, 7)""", "gesture_cells"),
    "s03_header": sql(SIZES + "SELECT recording_id, i AS frame_idx, frame_idx AS frame_number, n AS num_obj, CAST(2 AS BIGINT) AS num_tlvs, '3.6.0.0' AS sdk, 'xWR6843' AS device FROM po", "points"),
    "s04_configs": CONFIGS + """    SELECT k AS cfg_id, CAST(tx AS BIGINT) AS n_tx, CAST(tx * 4 AS BIGINT) AS n_virtual, CAST(bins AS BIGINT) AS range_bins, CAST(loops AS DOUBLE) AS loops,
      round(start_actual, 6) AS start_actual, round(slope_actual, 6) AS slope_actual, round(centre, 6) AS centre_ghz,
      round(3e8 * ksps * 1e3 / (2 * slope_actual * 1e12 * bins), 6) AS range_spacing, round(3e8 / (4 * centre * 1e9 * chirp * tx), 6) AS max_velocity, round(3e8 / (2 * centre * 1e9 * chirp * tx * loops), 6) AS velocity_spacing,
      round(1000 / (k % 90 + 10), 6) AS fps, round(pow(2, ceil(log2(tx * 4))) / (tx * 4) / 256, 6) AS log_to_linear, round(20 * log10(2), 6) AS bins_per_db, round(32 / bins, 6) AS compensation, round(20 * log10(32 / bins), 6) + 0.0 AS compensation_db,
      CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN '0,2,1' ELSE '0,-1,1' END ELSE CASE WHEN k % 3 = 0 THEN '0,1,2' ELSE '0,1,-1' END END AS slots, 'calibDcRangeSig' AS unread,
      CASE WHEN k % 3 = 0 THEN '' ELSE 'cannot read: chirpCfg 2 two' END AS warnings FROM c""",
    "s05_expected_tlvs": f"""SELECT {_K} AS cfg_id, concat_ws(',', CASE WHEN {_K} % 3 > 0 THEN 1 END, CASE WHEN {_K} % 3 = 1 THEN 7 END, CASE WHEN {_K} // 2 % 2 = 1 THEN 2 END, CASE WHEN {_K} // 3 % 2 = 1 THEN 3 END, CASE WHEN {_K} // 5 % 2 = 1 THEN 4 END,
      CASE WHEN {_K} // 7 % 2 = 1 THEN 5 END, CASE WHEN {_K} // 11 % 2 = 1 THEN 6 END, CASE WHEN {_K} // 11 % 2 = 1 THEN 9 END) AS expected FROM part""",
    "s06_runs": _files_sql("SELECT dir, 'a.dat' AS dat, CASE WHEN o % 4 <> 0 THEN 'a.cfg' ELSE 'default.cfg' END AS cfg, o % 4 = 0 AS cfg_is_fallback FROM fl WHERE o % 13 <> 0"),
    "s07_latest": _files_sql("SELECT dir, modified_at, CASE WHEN o % 13 = 0 THEN 'b.dat' ELSE 'a.dat' END AS name FROM fl ORDER BY modified_at DESC, dir DESC LIMIT 1"),
    "s08_background_runs": _files_sql(""", r AS (SELECT dir, regexp_extract(dir, '^(.*)/[^/]*$', 1) AS parent, o % 4 <> 0 AS has_cfg FROM fl WHERE o % 13 <> 0), e AS (SELECT parent, min(dir) AS background FROM r WHERE regexp_extract(dir, '[^/]*$') LIKE '%empty%' AND has_cfg GROUP BY 1)
      SELECT dir, background FROM r LEFT JOIN e USING (parent) WHERE background IS NULL OR dir <> background"""),
    "s09_manifest": sql(PAYLOADS + WALK + SPECTRUM + FEATURES + CONFIGS.replace("WITH a AS", ", a AS", 1) + """, ag AS (SELECT *, frame_number - lag(frame_number) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS gap FROM audit_frames),
      su AS (SELECT recording_id, count(*) AS n_frames, CAST(sum(num_points) AS BIGINT) AS n_points, CAST(sum(skipped_before) AS BIGINT) AS lost, count(*) FILTER (skipped_before > 0) AS resyncs, CAST(coalesce(sum(gap - 1) FILTER (gap > 1), 0) AS BIGINT) AS frames_lost,
        count(*) FILTER (num_obj <> num_points) AS mism, count(anomaly) AS odd FROM ag GROUP BY 1),
      tq AS (SELECT recording_id, avg(CASE WHEN range_m IS NOT NULL THEN 1.0e0 ELSE 0 END) AS vf FROM frame_spine LEFT JOIN (""" + TRACKS + """) USING (recording_id, frame_idx) GROUP BY 1),
      tg AS (SELECT recording_id, method, count(*) AS n, count(*) FILTER (is_ghost) AS tagged FROM lab GROUP BY 1, 2 UNION ALL SELECT recording_id, NULL, NULL, NULL FROM su)
    SELECT su.recording_id, coalesce(tg.method, 'raw_unfiltered') AS bucket, n_frames, n_points, lost AS integrity_lost_bytes, resyncs AS integrity_resyncs, frames_lost AS integrity_frames_lost, mism AS integrity_count_mismatches,
      CASE WHEN lost > 0 AND mism > 0 THEN 'not complete: bytes skipped, counts differ' WHEN lost > 0 THEN 'not complete: bytes skipped' WHEN mism > 0 THEN 'not complete: counts differ' ELSE 'complete' END AS integrity_verdict,
      CASE WHEN odd > 0 THEN '{"unknown_tlv_type":' || odd || '}' END AS integrity_anomalies, CASE WHEN has_map OR has_angle THEN 'B' WHEN has_profile THEN 'C+' ELSE 'C' END AS tier,
      CAST(to_json(list_filter([CASE WHEN has_points THEN 'points' END, CASE WHEN has_profile THEN 'profile' END, CASE WHEN has_noise THEN 'noise' END, CASE WHEN has_angle THEN 'angle' END, CASE WHEN has_map THEN 'map' END, CASE WHEN has_stats THEN 'stats' END, CASE WHEN has_side THEN 'side' END, CASE WHEN has_temperature THEN 'temperature' END], lambda x: x IS NOT NULL)) AS VARCHAR) AS payloads,
      CASE WHEN has_map THEN 'range-Doppler map' WHEN has_profile THEN 'range profile' ELSE 'points' END AS provenance_range_time, CASE WHEN coalesce(vf, 0) > 0 THEN 'following the track' ELSE 'fixed region' END AS provenance_velocity_time, CASE WHEN has_map THEN 'map' ELSE 'points' END AS provenance_envelope, round(vf, 6) AS provenance_valid_fraction,
      CAST(bins AS BIGINT) AS geometry_range_bins, round(3e8 * ksps * 1e3 / (2 * slope_actual * 1e12 * bins), 6) AS geometry_range_spacing, round(3e8 / (2 * centre * 1e9 * chirp * tx * loops), 6) AS geometry_velocity_spacing, round(3e8 / (4 * centre * 1e9 * chirp * tx), 6) AS geometry_max_velocity, round(1000 / (c.k % 90 + 10), 6) AS geometry_fps, CAST(tx * 4 AS BIGINT) AS geometry_n_virtual,
      round(duration, 6) + 0.0 AS metrics_duration, round(t_walk, 6) + 0.0 AS metrics_t_walk, n_segments AS metrics_n_segments, n_steps AS metrics_n_steps, round(mean_interval, 6) AS metrics_mean_interval, round(sd_interval, 6) AS metrics_sd_interval, round(median_interval, 6) AS metrics_median_interval,
      round(CASE WHEN su.recording_id % 3 = 0 AND su.recording_id % 5 > 0 THEN 100.0e0 * abs(n_steps - su.recording_id % 5) / (su.recording_id % 5) END, 6) + 0.0 AS metrics_mape_percent, round(cadence, 6) + 0.0 AS metrics_cadence, round(CASE WHEN mean_interval > 0 THEN 100 * sd_interval / mean_interval END, 6) AS metrics_cv_percent,
      round(CASE WHEN duration > 0 THEN t_walk / duration ELSE 0 END, 6) + 0.0 AS metrics_walking_fraction, round(cadence_spectral, 6) AS metrics_cadence_spectral, round(confidence, 6) AS metrics_confidence, round(CASE WHEN cadence > 0 THEN 100 * abs(cadence - cadence_spectral) / cadence END, 6) + 0.0 AS metrics_cadence_gap_percent,
      round(greatest(0.2e0, 3e8 / (2 * centre * 1e9 * chirp * tx * loops)), 6) AS parameters_v_min, round(least(8.0e0, bins * 3e8 * ksps * 1e3 / (2 * slope_actual * 1e12 * bins)), 6) AS parameters_far_m,
      tg.method AS method_name, tg.n AS method_n_points, tg.tagged AS method_n_tagged, round(tg.tagged / tg.n, 6) AS method_fraction
    FROM su JOIN tg USING (recording_id) LEFT JOIN fl USING (recording_id) LEFT JOIN tq USING (recording_id) LEFT JOIN met USING (recording_id) LEFT JOIN sp USING (recording_id) LEFT JOIN c ON c.k = su.recording_id""", "points", "frame_spine", "audit_frames", "envelope"),
    "s10_in_order": sql("SELECT recording_id, frame_idx, CAST(CASE WHEN frame_idx < 50 THEN 0 ELSE 1 END AS BIGINT) AS part FROM frame_spine", "frame_spine"),
    "l01_reassemble": sql(SIZES + "SELECT recording_id, i AS frame_idx, byte_offset, CAST(gap AS BIGINT) AS skipped_before, length, round(((byte_offset + length - 1) // 1000 - min((byte_offset + length - 1) // 1000) OVER (PARTITION BY recording_id)) / 10, 6) + 0.0 AS t FROM po", "points"),
    "l02_raw": sql(SIZES + "SELECT recording_id, i AS frame_idx, byte_offset, length FROM po", "points"),
    "l02_index": sql(SIZES + """SELECT recording_id, i AS frame_idx, round(((byte_offset + length - 1) // 1000 - min((byte_offset + length - 1) // 1000) OVER (PARTITION BY recording_id)) / 10, 6) + 0.0 AS t, frame_idx AS frame, CAST(0 AS BIGINT) AS sub,
      CAST(frame_idx * 8000000 AS BIGINT) AS cycles, byte_offset AS off, n AS n_pts, '1,7' AS tlvs, CAST(NULL AS VARCHAR) AS anom FROM po""", "points"),
    "l03_stream_gate": "SELECT l_suppkey AS recording_id, l_partkey % 100 AS frame_idx, round(l_quantity, 6) AS l_quantity FROM lineitem WHERE l_quantity >= 25",
    "l03_walking": sql(WALK + """, rows_ AS (SELECT s3.*, CASE WHEN st = 1 THEN (sum(CASE WHEN turn = 1 AND st = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame_idx)) END AS walk, CASE WHEN st = 1 THEN t - min(t) OVER (PARTITION BY recording_id, island) END AS seconds,
        coalesce(v, 0) AS x, lag(coalesce(v, 0)) OVER w AS b, lag(coalesce(v, 0), 2) OVER w AS a, lag(st) OVER w AS was FROM s3 WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx))
      SELECT recording_id, frame_idx, st = 1 AS walking, CAST(walk AS BIGINT) AS walk, round(seconds, 6) + 0.0 AS seconds, coalesce(was = 1 AND a < b AND b > x AND b >= 0.2, false) AS step_before FROM rows_""", "envelope"),
    "m13_axes": CONFIGS + """, ax AS (SELECT k, 'range' AS axis, unnest(range(CAST(bins AS BIGINT))) AS bin, 3e8 * ksps * 1e3 / (2 * slope_actual * 1e12 * bins) AS w FROM c
      UNION ALL SELECT k, 'velocity', unnest(range(loops)), 3e8 / (2 * centre * 1e9 * chirp * tx * loops) FROM c)
    SELECT ax.k AS cfg_id, axis, CAST(bin AS INT) AS bin, round(CASE axis WHEN 'range' THEN greatest(bin * w - ax.k % 10 * 0.01e0, 0) ELSE (bin - loops // 2) * w END, 6) + 0.0 AS value FROM ax JOIN c ON c.k = ax.k""",
    "l04_decisions": sql(STATES + "SELECT recording_id, frame_idx, state, fired FROM ev", "gesture_cells"),
    "l04_correlation": sql(""", ft AS (SELECT recording_id, frame_idx, max(feature) FILTER (k = 5) AS f5, max(feature) FILTER (k = 0) AS f0 FROM gesture_cells GROUP BY 1, 2)
      SELECT recording_id, frame_idx, round(CASE WHEN count(*) OVER w < 20 THEN 0 ELSE coalesce(corr(f5, f0) OVER w, 0) END, 6) + 0.0 AS correlation FROM ft WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "gesture_cells"),
    "l05_health": f"""WITH RECURSIVE r AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, event_type NOT IN ('signup', 'error') AND value > 0 AS b, event_type = 'error' AS f FROM events),
    w AS (SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS deadline, 'new' AS st, false AS seen, CAST([] AS STRUCT(m BIGINT, h VARCHAR)[]) AS told FROM r
      UNION ALL
      SELECT recording_id, i, CASE WHEN b OR st1 = 'new' THEN ms + {SILENCE * 1000} ELSE deadline END, CASE WHEN f THEN 'stopped' WHEN b THEN 'ok' WHEN st1 = 'new' THEN 'waiting' ELSE st1 END, seen OR b,
        list_concat(list_concat(CASE WHEN st1 <> st THEN [{{'m': deadline, 'h': st1}}] ELSE [] END, CASE WHEN b AND st1 <> 'ok' THEN [{{'m': ms, 'h': 'ok'}}] ELSE [] END), CASE WHEN f AND st1 <> 'stopped' THEN [{{'m': ms, 'h': 'stopped'}}] ELSE [] END)
      FROM (SELECT r.*, st, seen, deadline, CASE WHEN st IN ('waiting', 'ok') AND ms > deadline THEN CASE WHEN seen THEN 'stopped' ELSE 'no data' END ELSE st END AS st1 FROM w JOIN r ON r.recording_id = w.recording_id AND r.i = w.i + 1)),
    tail AS (SELECT recording_id, deadline, st, seen FROM w QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY i DESC) = 1)
    SELECT recording_id, u.m AS at_ms, u.h AS health FROM (SELECT recording_id, unnest(told) AS u FROM w)
    UNION ALL SELECT recording_id, deadline, CASE WHEN seen THEN 'stopped' ELSE 'no data' END FROM tail WHERE st IN ('waiting', 'ok') AND deadline < (SELECT max(ms) FROM r) - 1""",
    "l07_track": FOLLOW_TWO,
    "l06_counters": sql("SELECT recording_id, count(*) AS n_frames, CAST(sum(num_points) AS BIGINT) AS n_points, CAST(sum(skipped_before) AS BIGINT) AS bytes_skipped FROM audit_frames GROUP BY 1", "audit_frames"),
}
