"""Range-time and velocity-time maps (M) and clutter (C).

A map is long: (recording_id, frame_idx, bin, value). Marginals of dense maps are array expressions over one row a frame,
so they shuffle nothing; sparse maps are partial and final hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dopplerlake.functions.scalars import amplitude, clip, range_of, to_db

FRAME = ["recording_id", "frame_idx"]


def range_axis(bins: int, spacing: float, bias: float = 0.0) -> Column:
    """Centre of each range bin, bias removed, not below zero."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.greatest(i * spacing - bias, F.lit(0.0)))


def velocity_axis(bins: int, spacing: float) -> Column:
    """Velocity of each Doppler bin, zero in the middle."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (i - bins // 2) * spacing)


def axes(configs: DataFrame) -> DataFrame:
    """Both axes of every configuration (cfg_id, range_bins, range_spacing, range_bias, velocity_bins, velocity_spacing):
    (cfg_id, axis, bin, value). A bias is taken off dense axes, never off points."""
    bins = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    ranges = F.transform(bins("range_bins"), lambda i: F.greatest(i * F.col("range_spacing") - F.col("range_bias"), F.lit(0.0)))
    velocities = F.transform(bins("velocity_bins"), lambda i: (i - F.floor(F.col("velocity_bins") / 2)) * F.col("velocity_spacing"))
    each = F.explode(F.array(F.struct(F.lit("range").alias("axis"), ranges.alias("v")), F.struct(F.lit("velocity").alias("axis"), velocities.alias("v")))).alias("e")
    return configs.select("cfg_id", each).select("cfg_id", "e.axis", F.posexplode("e.v").alias("bin", "value"))


def true_resolution(configs: DataFrame) -> DataFrame:
    """Velocity resolution from bin spacing, bins and chirps."""
    return configs.withColumn("velocity_resolution", F.col("velocity_spacing") * F.col("velocity_bins") / F.col("chirps"))


def shift_doppler(frames: DataFrame, dopplers: int) -> DataFrame:
    """Rolls every range row by half its length, so that zero Doppler is in the middle."""
    half = dopplers // 2
    place = lambda i: F.floor(i / dopplers).cast("int") * dopplers + (i + half) % dopplers
    return frames.withColumn("rd", F.transform("rd", lambda v, i: F.get("rd", place(i))))


def _present(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def range_time_dense(frames: DataFrame, ranges: int, dopplers: int) -> DataFrame:
    """M1: sums over Doppler, missing cells as zero; one short expression whatever the size of the map."""
    one = lambda r: F.aggregate(F.slice("rd", r * dopplers + 1, F.lit(dopplers)), F.lit(0.0), lambda s, x: s + _present(x))
    sums = F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), one)
    return frames.select(*FRAME, F.posexplode(sums).alias("bin", "value")).withColumn("bin", F.col("bin").cast("long"))


def velocity_time_dense(frames: DataFrame, ranges: int, dopplers: int, first: int = 0, last: int | None = None) -> DataFrame:
    """M5: sums over the range bins first..last: the map's rows are added up as arrays."""
    last = ranges - 1 if last is None else last
    add = lambda s, r: F.zip_with(s, F.slice("rd", r * dopplers + 1, F.lit(dopplers)), lambda a, x: a + _present(x))
    sums = F.aggregate(F.sequence(F.lit(first), F.lit(last)), F.array_repeat(F.lit(0.0), dopplers), add)
    return frames.select(*FRAME, F.posexplode(sums).alias("bin", "value")).withColumn("bin", F.col("bin").cast("long"))


def range_time_profile(profile: DataFrame) -> DataFrame:
    """M2: the measured profile (dB) as a map."""
    return profile.select(*FRAME, F.col("range_bin").alias("bin"), F.col("value_db").alias("value"))


def profile_scaled(frames: DataFrame, scale: float, to_decibel: float = 20 * 0.30102999566398120, offset: float = 0.0) -> DataFrame:
    """Raw profile counts to dB and to linear values."""
    db = F.transform("raw", lambda x: x * scale * to_decibel + offset)
    linear = F.transform("raw", lambda x: F.pow(F.lit(2.0), x * scale))
    return frames.select(*FRAME, F.posexplode(F.arrays_zip(db.alias("db"), linear.alias("linear"))).alias("bin", "z")).select(*FRAME, F.col("bin").cast("long").alias("bin"), "z.db", "z.linear")


def sparse_range_time(points: DataFrame, spacing: float, bins: int) -> DataFrame:
    """M3, M4: points summed by range bin (half-even, clipped), weight 10^(SNR/20) or 1; filter the points for a mask."""
    b = clip(F.rint(range_of() / spacing), 0, bins - 1).cast("long")
    return points.groupBy(*FRAME, b.alias("bin")).agg(F.sum(amplitude(F.col("snr_db"))).alias("value"))


def sparse_velocity_time(points: DataFrame, spacing: float, bins: int, near: float | None = None, far: float | None = None) -> DataFrame:
    """M6: as M3 on velocity, within a range gate."""
    if near is not None:
        points = points.where(range_of().between(near, far))
    b = clip(F.rint(F.col("v") / spacing) + bins // 2, 0, bins - 1).cast("long")
    return points.groupBy(*FRAME, b.alias("bin")).agg(F.sum(amplitude(F.col("snr_db"))).alias("value"))


def following_velocity_time(points: DataFrame, tracks: DataFrame, spacing: float, bins: int, width: float = 0.25) -> DataFrame:
    """M7: velocity-time of the points within `width` of the track of their frame; fails on a recording without any track value."""
    any_value = F.count("range_m").over(Window.partitionBy("recording_id"))
    checked = tracks.withColumn("range_m", F.when(any_value == 0, F.raise_error(F.lit("the track has no value")).cast("double")).otherwise(F.col("range_m")))
    near = points.join(checked.select(*FRAME, "range_m"), FRAME).where(F.abs(range_of() - F.col("range_m")) <= width)
    return sparse_velocity_time(near, spacing, bins)


def gate_range(values: DataFrame, spacing: float, near: float, far: float) -> DataFrame:
    """M8: the map's bins between near and far; an empty gate is an error."""
    if near > far:
        raise ValueError("the range gate is empty")
    return values.where((F.col("bin") * spacing).between(near, far))


def decibels(values: DataFrame) -> DataFrame:
    """M9: linear map values to dB."""
    return values.withColumn("value", to_db(F.col("value")))


def display_limits(values: DataFrame, low: float = 0.35, high: float = 0.995) -> DataFrame:
    """Percentiles of each recording's finite cells; (0, 1) if there are none."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    q = F.percentile(finite, F.array(F.lit(low), F.lit(high)))
    return values.groupBy("recording_id").agg(q.alias("q")).select("recording_id", F.coalesce(F.get("q", F.lit(0)), F.lit(0.0)).alias("low"), F.coalesce(F.get("q", F.lit(1)), F.lit(1.0)).alias("high"))


def best_source(dense: DataFrame, profile: DataFrame, sparse: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each recording's map from its best payload, by the flags of A16: the dense map, else the profile, else points."""
    take = lambda df, source, keep: df.join(payloads.where(keep).select("recording_id"), "recording_id", "left_semi").withColumn("source", F.lit(source))
    return take(dense, "rd", "has_map").unionByName(take(profile, "profile", "has_profile and not has_map")).unionByName(take(sparse, "points", "not has_profile and not has_map"))


def frame_pair(frames: DataFrame, frame: int, ranges: int, dopplers: int) -> DataFrame:
    """Both marginals of one frame, labelled."""
    one = frames.where(F.col("frame_idx") == frame)
    return range_time_dense(one, ranges, dopplers).withColumn("map", F.lit("RT")).unionByName(velocity_time_dense(one, ranges, dopplers).withColumn("map", F.lit("VT")))


def mean_profiles(signal: DataFrame, threshold: float) -> DataFrame:
    """Mean signal and noise profile over time, margin and whether it passes the detection threshold."""
    m = signal.groupBy("recording_id", "range_bin").agg(F.avg("value_db").alias("signal_db"), F.avg("noise_db").alias("noise_db"))
    return m.withColumn("margin_db", F.col("signal_db") - F.col("noise_db")).withColumn("passes", F.col("margin_db") > threshold)


def notch_map(frames: DataFrame, dopplers: int, k: int) -> DataFrame:
    """Zero within k bins of the middle (zero) Doppler bin."""
    return frames.withColumn("rd", F.transform("rd", lambda v, i: F.when(F.abs(i % dopplers - dopplers // 2) <= k, 0.0).otherwise(v)))


def subtract_baseline(values: DataFrame, method: str = "median", linear: bool = True) -> DataFrame:
    """Takes off each bin's median, mean or 20th percentile over time; linear maps do not go below zero."""
    base = {"median": F.percentile("value", F.lit(0.5)), "mean": F.avg("value"), "percentile": F.percentile("value", F.lit(0.2))}[method]
    b = values.groupBy("recording_id", "bin").agg(base.alias("base"))
    left = F.col("value") - F.col("base")
    return values.join(b, ["recording_id", "bin"]).withColumn("value", F.greatest(left, F.lit(0.0)) if linear else left).drop("base")


def subtract_empty_scene(cells: DataFrame, background: DataFrame) -> DataFrame:
    """Takes the empty scene's mean off each range-Doppler cell, clipped at zero; every cell must be in the background."""
    b = background.groupBy("recording_id", "range_bin", "dop_bin").agg(F.avg("value").alias("base"))
    joined = cells.join(b, ["recording_id", "range_bin", "dop_bin"], "left")
    base = F.coalesce("base", F.raise_error(F.lit("the background has another geometry")).cast("double"))
    return joined.withColumn("value", F.greatest(F.col("value") - base, F.lit(0.0))).drop("base")
