"""Envelope, walking segments, steps and gait metrics (G), keyed by recording; series are windows over frame_idx."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

R, FRAME = "recording_id", ["recording_id", "frame_idx"]
MAD = 1.4826


def robust_mask(cells: DataFrame, k: float = 3.0, keys: list[str] = FRAME) -> DataFrame:
    """G1: cells above median + k 1.4826 MAD of their frame; with no spread, above the median."""
    m = cells.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("med"))
    c = cells.join(m, keys)
    d = c.groupBy(*keys).agg(F.percentile(F.abs(F.col("value") - F.col("med")), F.lit(0.5)).alias("mad"))
    limit = F.when(F.col("mad") <= 0, F.col("med")).otherwise(F.col("med") + k * MAD * F.col("mad"))
    return c.join(d, keys).withColumn("kept", F.col("value") > limit).drop("med", "mad")


def dense_envelope(vt: DataFrame, spacing: float, bins: int, slowest: float = 0.0, k: float = 3.0) -> DataFrame:
    """p98 of |v| over a frame's masked velocity bins outside the middle three and above `slowest`; share of masked bins over all."""
    off = F.col("bin") - bins // 2
    m = robust_mask(vt, k).withColumn("speed", F.abs(off * spacing)).withColumn("use", F.col("kept") & (F.abs(off) > 1) & (F.col("speed") > slowest))
    return m.groupBy(*FRAME).agg(F.percentile(F.when(F.col("use"), F.col("speed")), F.lit(0.98)).alias("v"), (F.count_if("use") / F.count("*")).alias("mask_fraction"))


def point_envelope(points: DataFrame, spine: DataFrame, k: float = 3.0) -> DataFrame:
    """Envelope from point speeds: none without points, the maximum below three, else p98 of those above the robust
    limit (or, if none is, of those at or above the median)."""
    p = points.select(*FRAME, F.abs("v").alias("value"))
    m = p.groupBy(*FRAME).agg(F.percentile("value", F.lit(0.5)).alias("med"))
    c = robust_mask(p, k).join(m, FRAME)
    e = c.groupBy(*FRAME).agg(
        F.count("*").alias("n"), F.max("value").alias("top"), F.percentile(F.when(F.col("kept"), F.col("value")), F.lit(0.98)).alias("masked"), F.percentile(F.when(F.col("value") >= F.col("med"), F.col("value")), F.lit(0.98)).alias("upper")
    )
    v = F.when(F.col("n") < 3, F.col("top")).otherwise(F.coalesce("masked", "upper"))
    return spine.join(e.select(*FRAME, v.alias("v")), FRAME, "left")


def smooth(series: DataFrame, half: int = 1) -> DataFrame:
    """Centred moving average over present values, shorter at the ends; fills a gap that has a neighbour."""
    w = Window.partitionBy(R).orderBy("frame_idx").rowsBetween(-half, half)
    return series.withColumn("v", F.avg("v").over(w))


def segments(series: DataFrame, on: float = 0.35, off: float = 0.20, shortest: float = 1.0) -> DataFrame:
    """Walking intervals by hysteresis (missing as zero), at least `shortest` seconds; they end the frame before the drop."""
    w = Window.partitionBy(R).orderBy("frame_idx")
    v = F.coalesce("v", F.lit(0.0))
    s = series.withColumn("on", F.coalesce(F.last(F.when(v >= on, 1).when(v < off, 0), ignorenulls=True).over(w), F.lit(0)))
    s = s.withColumn("turn", F.when(F.col("on") != F.lag("on", 1, 0).over(w), 1).otherwise(0)).withColumn("island", F.sum("turn").over(w)).where("on = 1")
    s = s.groupBy(R, "island").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    kept = s.where(F.round(F.col("t1") - F.col("t0"), 9) >= shortest)
    return kept.withColumn("segment", F.row_number().over(Window.partitionBy(R).orderBy("first")).cast("long")).drop("island")


def _bases(v: np.ndarray) -> np.ndarray:
    """For each sample the least one between it and the nearest higher sample before it: one pass, with a stack of the samples
    that no later one has reached."""
    out, stack = np.empty(len(v)), []
    for i, x in enumerate(v.tolist()):
        low = x
        while stack and stack[-1][0] <= x:
            low = min(low, stack.pop()[1])
        stack.append((x, low))
        out[i] = low
    return out


def pick_peaks(v: np.ndarray, height: float, distance: int, prominence: float) -> np.ndarray:
    """Local maxima (middles of plateaus) at `height` or more, thinned to `distance` highest first, of `prominence` or more.

    Every part is one pass over the samples or over neighbouring peaks.
    """
    if len(v) < 3:
        return np.zeros(0, int)
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))  # level stretches
    stop, level = np.concatenate((start[1:], [len(v)])) - 1, v[start]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    p = ((start[top] + stop[top]) // 2)[level[top] >= height]
    alive = np.ones(len(p), bool)
    for i in np.argsort(v[p], kind="stable")[::-1].tolist():
        if alive[i]:
            for way in (-1, 1):
                j = i + way
                while 0 <= j < len(p) and abs(p[j] - p[i]) < distance:
                    alive[j] = False
                    j += way
    p = p[alive]
    base = np.maximum(_bases(v)[p], _bases(v[::-1])[::-1][p])
    return p[v[p] - base >= prominence]


def steps(series: DataFrame, walking: DataFrame, v_min: float = 0.20, spacing: float = 0.25) -> DataFrame:
    """Peaks of the envelope of each recording; inside walking segments where the recording has any."""
    gap = series.withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy(R).orderBy("frame_idx")))
    params = gap.groupBy(R).agg(F.percentile("dt", F.lit(0.5)).alias("dt"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    rows = series.join(params.select(R, F.coalesce(F.greatest(F.lit(1.0), F.rint(spacing / F.col("dt"))), F.lit(1.0)).alias("distance"), F.greatest(0.15 * (F.get("q", F.lit(1)) - F.get("q", F.lit(0))), F.lit(1e-6)).alias("prominence")), R)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        v = pdf["v"].fillna(0.0).to_numpy()
        at = pick_peaks(v, v_min, int(pdf["distance"].iloc[0]), float(pdf["prominence"].fillna(1e-6).iloc[0]))
        return pdf.iloc[at][[R, "frame_idx", "t", "v"]]

    peaks = rows.select(R, "frame_idx", "t", "v", "distance", "prominence").groupBy(R).applyInPandas(run, f"{R} long, frame_idx long, t double, v double")
    has = walking.select(R).distinct().withColumn("has", F.lit(True))
    inside = walking.select(R, "segment", "first", "last")
    hit = peaks.join(inside, (peaks[R] == inside[R]) & peaks["frame_idx"].between(inside["first"], inside["last"]), "left").select(peaks[R], "frame_idx", "t", "v", "segment")
    return hit.join(has, R, "left").where("has is null or segment is not null").drop("has")


def intervals(step_rows: DataFrame) -> DataFrame:
    """Seconds between successive steps of one walking segment."""
    w = Window.partitionBy(R, "segment").orderBy("t")
    return step_rows.where("segment is not null").withColumn("interval", F.col("t") - F.lag("t").over(w)).where("interval is not null")


def metrics(series: DataFrame, walking: DataFrame, step_rows: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Steps, walking time and fraction, cadence 60 n / T, and mean, sd, median and CV of intervals; no division by zero.
    With `truth` (recording_id, n_true) also the error of the count in percent of the true one."""
    whole = series.groupBy(R).agg((F.max("t") - F.min("t")).alias("duration"))
    walk = walking.groupBy(R).agg(F.sum(F.col("t1") - F.col("t0")).alias("t_walk"), F.count("*").alias("n_segments"))
    n = step_rows.groupBy(R).agg(F.count("*").alias("n_steps"))
    i = intervals(step_rows).groupBy(R).agg(F.avg("interval").alias("mean_interval"), F.stddev_samp("interval").alias("sd_interval"), F.percentile("interval", F.lit(0.5)).alias("median_interval"))
    m = whole.join(walk, R, "left").join(n, R, "left").join(i, R, "left").na.fill(0, ["t_walk", "n_segments", "n_steps"])
    if truth is not None:
        error = F.when(F.col("n_true") > 0, 100 * F.abs(F.col("n_steps") - F.col("n_true")) / F.col("n_true"))
        m = m.join(truth, R, "left").withColumn("mape_percent", error).drop("n_true")
    return m.withColumns({
        "cadence": F.when(F.col("t_walk") > 0, 60 * F.col("n_steps") / F.col("t_walk")).otherwise(0.0), "cv_percent": F.when(F.col("mean_interval") > 0, 100 * F.col("sd_interval") / F.col("mean_interval")),
        "walking_fraction": F.when(F.col("duration") > 0, F.col("t_walk") / F.col("duration")).otherwise(0.0),
    })


def spectral_cadence(series: DataFrame, period: float, low: float = 0.5, high: float = 4.0) -> DataFrame:
    """Strongest frequency of the de-meaned, Hann-weighted envelope between low and high Hz, in steps a minute, and its
    share; null and 0 for recordings of fewer than 8 frames, or without a frequency between them.

    A task transforms an Arrow batch of recordings, one array each (8 bytes a frame); a transform is n log n.
    """
    a = F.array_sort(F.collect_list(F.struct("frame_idx", F.coalesce(F.nanvl("v", F.lit(None).cast("double")), F.lit(0.0)).alias("v"))))
    rows = series.groupBy(R).agg(F.transform(a, lambda x: x["v"]).alias("v"))

    def one(v: np.ndarray) -> tuple[float | None, float]:
        n = len(v)
        first, last = math.ceil(low * n * period - 1e-9), min(math.floor(high * n * period + 1e-9), n // 2)
        if n < 8 or first > last:
            return None, 0.0
        m = np.abs(np.fft.rfft((v - v.mean()) * np.hanning(n)))[first : last + 1]
        k, total = first + int(m.round(9).argmax()), m.sum()
        return 60 * k / (n * period), m.max() / total if total > 0 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, at = v.flatten().to_numpy(), v.offsets.to_numpy() - (v.offsets[0].as_py() if len(v) else 0)
            got = [one(flat[i:j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(R), pa.array([x for x, _ in got], pa.float64()), pa.array([x for _, x in got], pa.float64())], [R, "cadence_spectral", "confidence"])

    return rows.mapInArrow(run, f"{R} long, cadence_spectral double, confidence double")


def disagreement(metric_rows: DataFrame, spectral: DataFrame) -> DataFrame:
    """Difference of the two cadences in percent of the one from steps."""
    j = metric_rows.join(spectral, R)
    return j.select(R, "cadence", "cadence_spectral", F.when(F.col("cadence") > 0, 100 * F.abs(F.col("cadence") - F.col("cadence_spectral")) / F.col("cadence")).alias("disagreement_percent"))


def interval_band(interval_rows: DataFrame) -> DataFrame:
    """Each interval with its recording's mean and mean -+ sd."""
    w = Window.partitionBy(R)
    m, sd = F.avg("interval").over(w), F.coalesce(F.stddev_samp("interval").over(w), F.lit(0.0))
    return interval_rows.select(R, "segment", "t", "interval", m.alias("mean"), (m - sd).alias("low"), (m + sd).alias("high"))


def chain(tracks: DataFrame, following: DataFrame, fixed: DataFrame) -> DataFrame:
    """The velocity-time map that follows the track, or the fixed-region one where the track was never measured."""
    valid = tracks.groupBy(R).agg(F.count("range_m").alias("n"))
    take = lambda df, keep, name: df.join(valid.where(keep).select(R), R, "left_semi").withColumn("source", F.lit(name))
    return take(following, "n > 0", "track").unionByName(take(fixed, "n = 0", "fixed"))
