"""Adapter views: the given tables in the shapes of radar recordings, for Spark and as SQL for DuckDB.

Facts are keyed by (recording_id, frame_idx[, point_idx | bin]). Geometry of the adapters: range bin 0.25 m, velocity bin
0.5 m/s, 64 range bins, 16 Doppler bins, frame period 0.04 s for points and 0.2 s for envelopes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BIN, VELOCITY_BIN, RANGE_BINS, DOPPLER_BINS = 0.25, 0.5, 64, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Detections, about six a frame; frames of 17 have no side information.

    Rows are shuffled as they were read, before anything is derived from them, for the places in their frames. `by` names the
    columns of the key to shuffle by, where that serves what follows too; the frame's number is then not carried along.
    """
    order = Window.partitionBy("recording_id", "frame_idx").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    keys = {"recording_id": F.col("recording_id"), "frame_idx": F.col("l_partkey") % 100}
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "recording_id")
    rows = (rows.repartition(*(keys[k] for k in by)) if by else rows).withColumn("frame_idx", keys["frame_idx"])
    frame, dark = F.col("frame_idx"), F.col("frame_idx") % 17 == 0
    return rows.withColumn("point_idx", (F.row_number().over(order) - 1).cast("long")).select(
        "recording_id", "frame_idx", "point_idx", (frame * 0.04).alias("t"),
        ((F.col("l_quantity") - 25.5) / 10).alias("x"), (F.col("l_extendedprice") / 20000).alias("y"), ((F.col("l_discount") - 0.05) * 20).alias("z"),
        F.round((F.col("l_tax") - 0.04) * 50, 1).alias("v"),
        F.when(~dark, ((F.col("l_orderkey") % 400) - 50) * 0.1).alias("snr_db"), F.when(~dark, (F.col("l_partkey") % 300) * 0.1).alias("noise_db"),
    )


def frame_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of every recording, the empty ones too (frame numbers 0 to 99)."""
    recordings = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("recording_id")).distinct()
    return recordings.select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("frame_idx")).withColumn("t", F.col("frame_idx") * 0.04)


def background_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd recordings are the empty room of the even one before."""
    return points(spark, sf_dir).where(F.col("recording_id") % 2 == 1).select((F.col("recording_id") - 1).alias("recording_id"), "x", "y", "z", "snr_db")


def _in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, numbered in each recording by time. What is derived from them stays partitioned by recording."""
    order = Window.partitionBy("recording_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumnRenamed("user_id", "recording_id")
    return rows.withColumn("frame_idx", (F.row_number().over(order) - 1).cast("long"))


def audit_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame headers and what was skipped before them, one recording for each user."""
    whole = F.floor("value")
    tlv = F.when(F.col("event_type") == "view", "1,7,2,6").when(F.col("event_type") == "click", "1,2").when(F.col("event_type") == "error", "2,6").when(F.col("event_type") == "signup", "1,7").otherwise("1,2,7,6,9")
    e = F.col("event_id")
    return _in_order(spark, sf_dir).select(
        "recording_id", "frame_idx", e.alias("frame_number"), (whole % 6).alias("num_obj"),
        F.when(e % 11 == 0, F.lit(0).cast("long")).otherwise(whole % 6).alias("num_points"), (32 * (2 + whole % 40)).alias("total_len"),
        F.when(e % 97 == 0, e % 31).otherwise(F.lit(0).cast("long")).alias("skipped_before"), tlv.alias("tlv_order"), F.unix_timestamp("ts").alias("t"),
        F.when(e % 13 == 0, F.concat(F.lit("unknown_tlv_type ("), "event_type", F.lit(")"))).alias("anomaly"),
    )


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foot-velocity envelopes; a fifth of the frames is missing."""
    return _in_order(spark, sf_dir).select("recording_id", "frame_idx", (F.col("frame_idx") * 0.2).alias("t"), F.when(F.col("event_type") != "error", F.col("value") / 100).alias("v"))


def emb_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 dense values a frame, exploded."""
    order = Window.partitionBy("label").orderBy("vec_id")
    frames = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("recording_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), "embedding")
    return frames.select("recording_id", "frame_idx", F.posexplode("embedding").alias("pos", "val")).select("recording_id", "frame_idx", F.col("pos").cast("long").alias("pos"), F.col("val").cast("double").alias("val"))


def dense_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a frame with its 64 values as one array: the layout dense payloads are stored in."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("recording_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("values"))


def rd_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-Doppler maps of 8 x 8, Doppler fastest, one array a frame."""
    return dense_frames(spark, sf_dir).select("recording_id", "frame_idx", F.transform("values", lambda v: F.abs(v) * 1000).alias("rd"))


def rd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_cells(spark, sf_dir).select("recording_id", "frame_idx", (F.col("pos") % 8).alias("dop_bin"), F.floor(F.col("pos") / 8).alias("range_bin"), (F.abs("val") * 1000).alias("value"))


def profile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_cells(spark, sf_dir).select("recording_id", "frame_idx", F.col("pos").alias("range_bin"), (20 * F.log10(F.abs("val") + 0.000001)).alias("value_db"))


def angle_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four range bins of eight complex antenna samples."""
    pair = F.floor(F.col("pos") / 2)
    part = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("val")))
    return emb_cells(spark, sf_dir).groupBy("recording_id", "frame_idx", F.floor(pair / 8).alias("range_bin"), (pair % 8).alias("ant")).agg(part(0).alias("re"), part(1).alias("im"))


def adc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 raw samples in one array a frame; their cube (chirps, receivers, samples) is named where they are used."""
    return dense_frames(spark, sf_dir).withColumnRenamed("values", "adc")


def gesture_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten features and ten class probabilities a frame."""
    cells = emb_cells(spark, sf_dir).where("pos < 20").groupBy("recording_id", "frame_idx", (F.col("pos") % 10).alias("k")).agg(
        F.max(F.when(F.col("pos") < 10, F.col("val") * 10)).alias("feature"), F.max(F.when(F.col("pos") >= 10, F.exp(60 * F.col("val")))).alias("e")
    )
    return cells.select("recording_id", "frame_idx", "k", "feature", (F.col("e") / F.sum("e").over(Window.partitionBy("recording_id", "frame_idx"))).alias("prob"))


#: The same views for DuckDB; later ones may use earlier ones.
SQL = {
    "points": """SELECT l_suppkey AS recording_id, l_partkey % 100 AS frame_idx,
       row_number() OVER (PARTITION BY l_suppkey, l_partkey % 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS point_idx,
       (l_partkey % 100) * 0.04e0 AS t, (l_quantity - 25.5e0) / 10 AS x, l_extendedprice / 20000 AS y, (l_discount - 0.05e0) * 20 AS z,
       round((l_tax - 0.04e0) * 50, 1) AS v,
       CASE WHEN (l_partkey % 100) % 17 = 0 THEN NULL ELSE ((l_orderkey % 400) - 50) * 0.1e0 END AS snr_db,
       CASE WHEN (l_partkey % 100) % 17 = 0 THEN NULL ELSE (l_partkey % 300) * 0.1e0 END AS noise_db FROM lineitem""",
    "frame_spine": "SELECT r.recording_id, f.frame_idx, f.frame_idx * 0.04e0 AS t FROM (SELECT DISTINCT l_suppkey AS recording_id FROM lineitem) r, (SELECT unnest(range(100)) AS frame_idx) f",
    "background_points": "SELECT recording_id - 1 AS recording_id, x, y, z, snr_db FROM points WHERE recording_id % 2 = 1",
    "audit_frames": """SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, event_id AS frame_number,
       CAST(floor(value) % 6 AS BIGINT) AS num_obj, CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE floor(value) % 6 END AS BIGINT) AS num_points,
       CAST(32 * (2 + floor(value) % 40) AS BIGINT) AS total_len, CASE WHEN event_id % 97 = 0 THEN event_id % 31 ELSE 0 END AS skipped_before,
       CASE event_type WHEN 'view' THEN '1,7,2,6' WHEN 'click' THEN '1,2' WHEN 'error' THEN '2,6' WHEN 'signup' THEN '1,7' ELSE '1,2,7,6,9' END AS tlv_order,
       CASE WHEN event_id % 13 = 0 THEN concat('unknown_tlv_type (', event_type, ')') END AS anomaly, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events""",
    "envelope": """SELECT user_id AS recording_id, row_number() OVER w - 1 AS frame_idx, (row_number() OVER w - 1) * 0.2e0 AS t,
       CASE WHEN event_type = 'error' THEN NULL ELSE value / 100 END AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "emb_cells": """SELECT CAST(label AS BIGINT) AS recording_id, frame_idx, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS val FROM
       (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, embedding FROM embeddings)""",
    "rd_cells": "SELECT recording_id, frame_idx, pos % 8 AS dop_bin, pos // 8 AS range_bin, abs(val) * 1000 AS value FROM emb_cells",
    "profile_cells": "SELECT recording_id, frame_idx, pos AS range_bin, 20 * log10(abs(val) + 0.000001e0) AS value_db FROM emb_cells",
    "angle_cells": """SELECT recording_id, frame_idx, (pos // 2) // 8 AS range_bin, (pos // 2) % 8 AS ant, max(CASE WHEN pos % 2 = 0 THEN val END) AS re,
       max(CASE WHEN pos % 2 = 1 THEN val END) AS im FROM emb_cells GROUP BY ALL""",
    "adc_cells": "SELECT recording_id, frame_idx, pos // 8 AS chirp, pos % 8 AS sample, val FROM emb_cells",
    "gesture_cells": """SELECT recording_id, frame_idx, k, feature, e / sum(e) OVER (PARTITION BY recording_id, frame_idx) AS prob FROM
       (SELECT recording_id, frame_idx, pos % 10 AS k, max(CASE WHEN pos < 10 THEN val * 10 END) AS feature, max(CASE WHEN pos >= 10 THEN exp(60 * val) END) AS e
        FROM emb_cells WHERE pos < 20 GROUP BY recording_id, frame_idx, pos % 10)""",
}
USES = {"background_points": ["points"], **{k: ["emb_cells"] for k in ("rd_cells", "profile_cells", "angle_cells", "adc_cells", "gesture_cells")}}


def sql(body: str, *views: str) -> str:
    """`body` (a SELECT, or more CTEs and a SELECT after a leading comma) over the named views."""
    order: list[str] = []
    for v in views:
        order += [u for u in USES.get(v, []) if u not in order] + ([v] if v not in order else [])
    head = "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in order)
    return head + ("" if body.lstrip().startswith(",") else "\n") + body
