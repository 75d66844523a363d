"""Integrity audit (A): every figure is one aggregate pass over frame headers, keyed by recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dopplerlake.functions.scalars import azimuth_of, range_of

R = "recording_id"


def summary(frames: DataFrame) -> DataFrame:
    """Bytes, resyncs, counter gaps, empty frames, mismatches and the verdict of each recording."""
    gap = F.col("frame_number") - F.lag("frame_number").over(Window.partitionBy(R).orderBy("frame_idx"))
    s = frames.withColumn("gap", gap).groupBy(R).agg(
        F.count("*").alias("n_frames"), F.sum("total_len").alias("bytes_in_frames"), F.sum("skipped_before").alias("bytes_skipped"), F.count_if(F.col("skipped_before") > 0).alias("resyncs"),
        F.coalesce(F.sum(F.when(F.col("gap") > 1, F.col("gap") - 1)), F.lit(0)).alias("frames_lost"), F.min_by("frame_number", "frame_idx").alias("first_number"), F.max_by("frame_number", "frame_idx").alias("last_number"),
        F.count_if(F.col("num_points") == 0).alias("zero_point_frames"), F.count_if(F.col("num_obj") != F.col("num_points")).alias("count_mismatches"), F.sum("num_points").alias("n_points"),
        F.count_if(~F.array_contains(F.split("tlv_order", ","), "7")).alias("frames_without_side_info"), *([_rate("*").alias("fps")] if "t" in frames.columns else []),
    )
    verdict = F.when(F.col("n_frames") == 0, "none").when((F.col("bytes_skipped") > 0) & (F.col("count_mismatches") > 0), "not complete: bytes skipped, counts differ").when(F.col("bytes_skipped") > 0, "not complete: bytes skipped").when(F.col("count_mismatches") > 0, "not complete: counts differ").otherwise("complete")
    return s.withColumn("verdict", verdict)


def tlv_counts(frames: DataFrame) -> DataFrame:
    """A5: how often each payload type occurs."""
    return frames.select(R, F.explode(F.split("tlv_order", ",").cast("array<int>")).alias("tlv")).groupBy(R, "tlv").count().withColumnRenamed("count", "n")


def tlv_orders(frames: DataFrame) -> DataFrame:
    """Payload orders, most frequent first; ties by the order's text."""
    n = frames.groupBy(R, "tlv_order").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(R).orderBy(F.desc("n"), "tlv_order")).cast("long"))


def anomaly_counts(frames: DataFrame) -> DataFrame:
    """Anomalies by the text before their bracket."""
    return frames.where("anomaly is not null").groupBy(R, F.substring_index("anomaly", " (", 1).alias("anomaly")).agg(F.count("*").alias("n"))


def field_of_view(points: DataFrame, far: float | None = None, fastest: float | None = None) -> DataFrame:
    """Extent of range, Doppler, azimuth, SNR and noise; points beyond the configured gates (null without a gate)."""
    p = points.withColumns({"r": range_of(), "a": azimuth_of()})
    beyond = lambda c, limit: F.count_if(c > limit) if limit is not None else F.lit(None).cast("long")
    extent = [f(c).alias(f"{n}_{name}") for name, c in (("range", "r"), ("v", "v"), ("azimuth", "a"), ("snr", "snr_db"), ("noise", "noise_db")) for n, f in (("min", F.min), ("max", F.max))]
    return p.groupBy(R).agg(*extent, F.count_if(F.col("v") == 0).alias("zero_doppler"), beyond(F.col("r"), far).alias("beyond_range"), beyond(F.abs("v"), fastest).alias("beyond_doppler"), F.count_if(F.col("snr_db") < 0).alias("negative_snr"), F.count_if(F.col("noise_db") < 0).alias("negative_noise"))


def early_stop(frames: DataFrame) -> DataFrame:
    """A10: what a reader loses that stops at the first empty frame, and frames whose first payload is points and whose second is
    another one than side info."""
    first_empty = F.min(F.when(F.col("num_obj") == 0, F.col("frame_idx")))
    order = F.split("tlv_order", ",")
    other = (F.get(order, F.lit(0)) == "1") & (F.get(order, F.lit(1)) != "7")
    return frames.groupBy(R).agg(first_empty.alias("first_empty"), F.count("*").alias("n_frames"), F.count_if(F.coalesce(other, F.lit(False))).alias("second_not_side_info")).withColumn("frames_lost", F.coalesce(F.col("n_frames") - F.col("first_empty"), F.lit(0)))


def bin_check(profiles: DataFrame, bins: int) -> DataFrame:
    """Size of the first profile of each recording against the configured number of range bins."""
    sizes = profiles.groupBy(R, "frame_idx").agg(F.count("*").alias("size"))
    return sizes.groupBy(R).agg(F.min_by("size", "frame_idx").alias("observed")).withColumns({"configured": F.lit(bins).cast("long"), "agrees": F.col("observed") == bins})


def device_mismatch(devices: DataFrame, configs: DataFrame) -> DataFrame:
    """Recordings whose device reports another platform or SDK than their configuration names."""
    joined = devices.join(configs, "cfg_id")
    return joined.where((F.col("platform") != F.col("cfg_platform")) | (F.col("sdk") != F.col("cfg_sdk"))).select(R, "cfg_id", "platform", "cfg_platform", "sdk", "cfg_sdk")


def _rate(what: str):
    """Count or sum a second, over the time from the first frame to the last; null for less than two times."""
    seconds = F.max("t") - F.min("t")
    return F.when(seconds > 0, (F.count("*") if what == "*" else F.sum(what)) / seconds)


def throughput(frames: DataFrame, baud: int) -> DataFrame:
    """Frames and bytes a second as measured by the frames' times (`t`, seconds), share of the link (baud / 10 bytes a
    second), and whether no byte was skipped."""
    s = frames.groupBy(R).agg(_rate("*").alias("fps"), _rate("total_len").alias("bytes_per_s"), (F.sum("skipped_before") == 0).alias("clean"))
    return s.select(R, "fps", "bytes_per_s", (F.col("bytes_per_s") / (baud / 10)).alias("utilisation"), "clean")


def best_clean(rates: DataFrame) -> DataFrame:
    """The clean recording of highest throughput (ties: the smaller id), or nothing."""
    return rates.where("clean and bytes_per_s is not null").agg(F.max_by(F.struct(R, "bytes_per_s"), F.struct("bytes_per_s", -F.col(R))).alias("b")).where("b is not null").select("b.*")


#: What a payload type says about a recording.
PAYLOADS = {"has_profile": (2,), "has_noise": (3,), "has_angle": (4, 8), "has_map": (5,), "has_stats": (6,), "has_side": (7,), "has_temperature": (9,)}


def availability(frames: DataFrame) -> DataFrame:
    """Which payloads a recording has, and its fidelity tier: B with range-Doppler maps or angle samples, C+ with range
    profiles, C with points alone. Points count where a frame has any."""
    order = F.split("tlv_order", ",").cast("array<int>")
    has = [F.bool_or(F.arrays_overlap(order, F.array(*map(F.lit, kinds)))).alias(name) for name, kinds in PAYLOADS.items()]
    s = frames.groupBy(R).agg(F.coalesce(F.bool_or(F.col("num_points") > 0), F.lit(False)).alias("has_points"), *has)
    return s.withColumn("tier", F.when(F.col("has_map") | F.col("has_angle"), "B").when(F.col("has_profile"), "C+").otherwise("C"))


def track_quality(tracks: DataFrame) -> DataFrame:
    """Share of frames with a measured range; warns at none and below a quarter."""
    s = tracks.groupBy(R).agg(F.avg(F.col("range_m").isNotNull().cast("double")).alias("valid_fraction"))
    return s.withColumn("warning", F.when(F.col("valid_fraction") == 0, "no target").when(F.col("valid_fraction") < 0.25, "few measurements").otherwise("none"))
