"""Gesture features, windows, scoring and decisions (F). Series are windows of a fixed number of rows a recording."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dopplerlake.functions.scalars import azimuth_of, elevation_of, power, range_of

FRAME = ["recording_id", "frame_idx"]
#: Class thresholds of the decision stage (probability, and votes that must be exceeded), for ten classes.
PROBABILITY = (0.99, 0.6, 0.6, 0.6, 0.6, 0.9, 0.9, 0.6, 0.6, 0.99)
VOTES = (4, 4, 4, 4, 4, 9, 9, 4, 4, 8)
LENGTH, CORRELATED, NETWORK = 15, 20, 6


def signed_doppler(d: Column, bins: int) -> Column:
    """bins in transform order to signed ones: 0..n/2-1, then -n/2..-1."""
    return F.when(d < bins // 2, d).otherwise(d - bins)


def suppress(cells: DataFrame, bins: int, n: int) -> DataFrame:
    """zero in Doppler bins 0..n and the last n."""
    return cells.withColumn("value", F.when((F.col("dop_bin") <= n) | (F.col("dop_bin") >= bins - n), 0.0).otherwise(F.col("value")))


def map_moments(cells: DataFrame, bins: int, first: int, stop: int, threshold: float | Column) -> DataFrame:
    """magnitude-weighted moments over range bins [first, stop): one conditional aggregate a frame."""
    d, v = signed_doppler(F.col("dop_bin"), bins), F.col("value")
    ratio = lambda up, down: F.when(down > 0, up / down).otherwise(0.0)
    part = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    up = F.col("dop_bin") < bins // 2
    w = cells.where((F.col("range_bin") >= first) & (F.col("range_bin") < stop)).groupBy(*FRAME).agg(
        F.sum("value").alias("s"), F.sum(v * d).alias("sd"), F.sum(v * F.col("range_bin")).alias("sr"), part(up, v).alias("p"), part(up, v * d).alias("pd"), part(~up, v).alias("m"), part(~up, v * d).alias("md"),
        F.count_if(v > threshold).alias("n_detections"),
    )
    c = F.col
    return w.select(*FRAME, ratio(c("sd"), c("s")).alias("doppler"), ratio(c("pd"), c("p")).alias("doppler_up"), ratio(c("md"), c("m")).alias("doppler_down"), ratio(c("sr"), c("s")).alias("range_bins"), c("n_detections").cast("double").alias("n_detections"), (c("s") / 10000).alias("energy"))


def heatmap_features(cells: DataFrame, bins: int, n: int, near: float, far: float, range_bin: float, ranges: int, scale: float) -> DataFrame:
    """log2 cells to magnitudes, F2, and F3 over a range window in metres; detections exceed 8 medians of non-zero cells."""
    linear = suppress(cells.withColumn("value", F.pow(F.lit(2.0), F.col("value") * scale)), bins, n)
    first, stop = max(1, round(near / range_bin)), min(ranges, round(far / range_bin) + 1)
    inside = linear.where((F.col("range_bin") >= first) & (F.col("range_bin") < stop))
    limit = inside.where("value > 0").groupBy(*FRAME).agg((F.percentile("value", F.lit(0.5)) * 8).alias("limit"))
    marked = inside.join(limit, FRAME, "left")
    n_over = marked.groupBy(*FRAME).agg(F.count_if(F.col("value") > F.col("limit")).cast("double").alias("n_detections"))
    return map_moments(inside, bins, first, stop, float("inf")).drop("n_detections", "energy").join(n_over, FRAME)


def point_features(points: DataFrame, spine: DataFrame, near: float, far: float, slowest: float, snr: float, range_bin: float, most: int = 10) -> DataFrame:
    """weighted moments of the `most` strongest gated points of each frame; frames without any are zero."""
    p = points.select(*FRAME, "point_idx", "v", range_of().alias("r"), azimuth_of().alias("az"), elevation_of().alias("el"), F.coalesce(power(F.col("snr_db")), F.lit(1.0)).alias("w"), F.coalesce("snr_db", F.lit(99.0)).alias("q"))
    p = p.where(F.col("r").between(near, far) & (F.abs("v") >= slowest) & (F.col("q") >= snr))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("w"), F.desc("point_idx")))).where(F.col("place") <= most)
    s = lambda x, c=None: F.coalesce(F.sum(F.when(c, F.col("w") * x) if c is not None else F.col("w") * x), F.lit(0.0))
    up, down, one = F.col("v") >= 0, F.col("v") < 0, F.lit(1.0)
    a = p.groupBy(*FRAME).agg(
        s(one).alias("t"), s(F.col("v")).alias("sv"), s(one, up).alias("u"), s(F.col("v"), up).alias("uv"), s(one, down).alias("d"), s(F.col("v"), down).alias("dv"), s(F.col("r")).alias("sr"),
        F.count("*").cast("double").alias("n"), s(F.col("az")).alias("sa"), s(F.col("el")).alias("se"), s(F.col("az") ** 2).alias("saa"), s(F.col("el") ** 2).alias("see"),
    )
    c, ratio = F.col, lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    f = a.select(
        *FRAME, ratio("sv", "t").alias("doppler"), ratio("uv", "u").alias("doppler_up"), ratio("dv", "d").alias("doppler_down"), (ratio("sr", "t") / range_bin).alias("range_bins"), c("n").alias("n_detections"),
        ratio("sa", "t").alias("azimuth"), ratio("se", "t").alias("elevation"), (ratio("saa", "t") - ratio("sa", "t") ** 2).alias("azimuth_spread"), (ratio("see", "t") - ratio("se", "t") ** 2).alias("elevation_spread"),
    )
    return spine.select(*FRAME).join(f, FRAME, "left").na.fill(0.0)


#: What stands in the places of the antenna vector, as (channel, sign), for a module whose second and fourth
#: receivers are fed from the other side; the last four places are of a transmitter that is off. The vector is scaled by 1 / 64.
ANTENNAS = ((3, -1), (2, 1), (1, -1), (0, 1))
ANGLES, SCALE = 32, 64


def angle_peaks(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed (azimuth, elevation) bins of the strongest of 32 x 32 angles of each cell of four channels (ties: the first).

    Two transforms follow each other: over the two antennas of a pair, then over the pairs; the first index is that of the pairs.
    """
    z = (re + 1j * im)[:, [c for c, _ in ANTENNAS]] * np.array([sign for _, sign in ANTENNAS]) / SCALE
    within = np.fft.fft(z.reshape(-1, 2, 2), ANGLES, axis=2)
    m = np.abs(np.fft.fft(within, ANGLES, axis=1)).reshape(len(z), -1)
    at = np.round(m, 9).argmax(axis=1)
    signed = lambda k: np.where(k > ANGLES // 2 - 1, k - ANGLES, k).astype(float)
    return signed(at // ANGLES), signed(at % ANGLES)


def angle_moments(cells: DataFrame, stop: int = 8, top: int = 10) -> DataFrame:
    """angle moments over the `top` strongest cells of each frame in range bins below `stop`, weighted by magnitude; frames
    without a positive cell are zero. Input: one row a cell with `re`, `im` arrays of four channels and `value`."""
    w = Window.partitionBy(*FRAME).orderBy(F.desc("value"), "range_bin", "dop_bin")
    best = cells.where((F.col("range_bin") < stop) & (F.col("value") > 0)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)

    @F.pandas_udf("struct<az:double,el:double>")
    def peak(re: pd.Series, im: pd.Series) -> pd.DataFrame:
        az, el = angle_peaks(np.stack(re.to_numpy()), np.stack(im.to_numpy())) if len(re) else (np.zeros(0), np.zeros(0))
        return pd.DataFrame({"az": az, "el": el})

    p = best.withColumn("p", peak("re", "im")).select(*FRAME, "value", "p.az", "p.el")
    m = lambda x: F.try_divide(F.sum(F.col("value") * x), F.sum("value"))
    a = p.groupBy(*FRAME).agg(m(F.col("az")).alias("azimuth"), m(F.col("el")).alias("elevation"), (m(F.col("az") ** 2) - m(F.col("az")) ** 2).alias("azimuth_spread"), (m(F.col("el") ** 2) - m(F.col("el")) ** 2).alias("elevation_spread"))
    return cells.select(*FRAME).distinct().join(a, FRAME, "left").na.fill(0.0)


def correlation(features: DataFrame, x: str = "azimuth", y: str = "doppler") -> DataFrame:
    """correlation over the last 20 frames; 0 before there are 20, and where either is constant."""
    w = Window.partitionBy("recording_id").orderBy("frame_idx").rowsBetween(-(CORRELATED - 1), 0)
    flat = (F.min(x).over(w) == F.max(x).over(w)) | (F.min(y).over(w) == F.max(y).over(w))
    # corr itself divides by the spread, even in branches not taken, so it is spelled out with guarded division
    mean = lambda c: F.avg(c).over(w)
    cov, var = mean(F.col(x) * F.col(y)) - mean(x) * mean(y), lambda c: mean(F.col(c) * F.col(c)) - mean(c) ** 2
    r = F.coalesce(F.try_divide(cov, F.sqrt(F.greatest(var(x) * var(y), F.lit(0.0)))), F.lit(0.0))
    return features.withColumn("correlation", F.when((F.count("*").over(w) < CORRELATED) | flat, 0.0).otherwise(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))))


def windows(features: DataFrame, columns: list[str], means: list[float], sds: list[float], length: int = LENGTH) -> DataFrame:
    """F8: the last `length` normalised feature rows as one array, oldest first, zeros before the start; ready once full."""
    w = Window.partitionBy("recording_id").orderBy("frame_idx").rowsBetween(-(length - 1), 0)
    row = F.array(*((F.col(c) - m) / s for c, m, s in zip(columns, means, sds)))
    got = F.flatten(F.collect_list(row).over(w))
    n = F.count("*").over(w)
    pad = F.array_repeat(F.lit(0.0), ((length - n) * len(columns)).cast("int"))
    return features.select(*FRAME, F.concat(pad, got).alias("window"), (n >= length).alias("ready"))


def score(window_rows: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """probabilities of each window by a small ReLU network with stable softmax, in Arrow batches; weights are broadcast."""
    shared = window_rows.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("array<double>")
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.stack(s.to_numpy()) if len(s) else np.zeros((0, shared.value[0][0].shape[1]))
            for i, (w, b) in enumerate(shared.value):
                x = x @ w.T + b
                x = np.maximum(x, 0) if i < len(shared.value) - 1 else x
            e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
            yield pd.Series(list(e / e.sum(axis=1, keepdims=True)) if len(x) else [])

    return window_rows.withColumn("probs", infer("window"))


def debounce(probs: DataFrame, thresholds=PROBABILITY, votes=VOTES, length: int = LENGTH) -> DataFrame:
    """a class votes where it reaches its threshold, passes with more than its votes in the last `length` frames,
    the highest passing class is the state; an event fires where the state turns to another class than 0."""
    order = Window.partitionBy("recording_id").orderBy("frame_idx")
    w = order.rowsBetween(-(length - 1), 0)
    passing = [F.when(F.sum(F.when(F.get("probs", F.lit(k)) >= t, 1).otherwise(0)).over(w) > v, k) for k, (t, v) in enumerate(zip(thresholds, votes))]
    s = probs.withColumn("state", F.coalesce(F.array_max(F.array(*passing)), F.lit(0)))
    s = s.withColumn("before", F.lag("state", 1, 0).over(order)).withColumn("fired", (F.col("state") != F.col("before")) & (F.col("state") != 0))
    return s.withColumn("probability", F.when(F.col("fired"), F.get("probs", F.col("state")))).drop("before")


def repeats(states: DataFrame, every: int) -> DataFrame:
    """while a class is held, an event at every `every`-th frame."""
    before = F.lag("state", 1, 0).over(Window.partitionBy("recording_id").orderBy("frame_idx"))
    return states.withColumn("repeated", (F.col("state") == before) & (F.col("state") != 0) & (F.col("frame_idx") % every == 0))


#: The features of one frame, in the order in which boards send them.
NAMES = ("doppler", "doppler_up", "doppler_down", "range_bins", "n_detections", "azimuth", "elevation", "correlation", "azimuth_spread", "elevation_spread")
ANGLE_COLUMNS = ("azimuth", "elevation", "azimuth_spread", "elevation_spread")
#: The features that the network reads, in its order.
NETWORK_ORDER = ("doppler", "azimuth", "elevation", "n_detections", "range_bins", "correlation")


def features_of(mode: str, board: DataFrame | None = None, points: DataFrame | None = None, heatmap: DataFrame | None = None) -> DataFrame:
    """the ten features of each frame by mode. `onchip` and `onchip_features` take those that the board sent (frames without
    are not there), `points` those of the point cloud; `heatmap` takes the map's, with the angles of the point cloud, as a map
    has no phase (zero where the frame has no points). The host's correlation is over the mode's own azimuth and Doppler."""
    if mode in ("onchip", "onchip_features"):
        return board.select(*FRAME, *NAMES)
    if mode == "points":
        f = points.select(*FRAME, *(c for c in NAMES if c != "correlation"))
    elif mode == "heatmap":
        f = heatmap.select(*FRAME, *(c for c in NAMES[:5])).join(points.select(*FRAME, *ANGLE_COLUMNS), FRAME, "left").na.fill(0.0, list(ANGLE_COLUMNS))
    else:
        raise ValueError(f"mode must be onchip, onchip_features, points or heatmap, not {mode}")
    return correlation(f).select(*FRAME, *NAMES)


def recognise(mode: str, features: DataFrame, layers=None, means=None, sds=None, board_probs: DataFrame | None = None, thresholds=PROBABILITY, votes=VOTES, warm_up: bool = True) -> DataFrame:
    """decisions of each frame by mode. `onchip` decides on the board's probabilities; the other modes window, normalise and
    score the features here. With `warm_up` only frames with a full window reach the decision stage: before, the state is 0."""
    if mode == "onchip":
        scored = features.select(*FRAME).join(board_probs.select(*FRAME, "probs"), FRAME).withColumn("ready", F.lit(True))
    else:
        scored = score(windows(features, list(NETWORK_ORDER), means, sds), layers)
    fed = scored.where("ready") if warm_up else scored
    told = debounce(fed, thresholds, votes).select(*FRAME, "state", "fired")
    return scored.join(told, FRAME, "left").select(*FRAME, "ready", "probs", F.coalesce("state", F.lit(0)).alias("state"), F.coalesce("fired", F.lit(False)).alias("fired"))


def event_counts(states: DataFrame) -> DataFrame:
    """events of each class."""
    return states.where("fired").groupBy("state").agg(F.count("*").alias("n"))


def agreement(host: DataFrame, board: DataFrame, skip: int = 15) -> DataFrame:
    """largest and mean difference of two probability series of a recording; the first `skip` frames are left out if there are more."""
    j = host.select(*FRAME, F.col("probs").alias("a")).join(board.select(*FRAME, F.col("probs").alias("b")), FRAME)
    d = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    w = Window.partitionBy("recording_id")
    j = j.select(*FRAME, F.array_max(d).alias("top"), F.aggregate(d, F.lit(0.0), lambda s, x: s + x).alias("sum"), F.size("a").alias("k")).withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("frame_idx"))})
    return j.where((F.col("n") <= skip) | (F.col("i") > skip)).groupBy("recording_id").agg(F.max("top").alias("max_difference"), (F.sum("sum") / F.sum("k")).alias("mean_difference"))


def training_windows(features: DataFrame, motion: list[str], length: int = LENGTH, stride: int = 1, quantile: float = 0.6) -> DataFrame:
    """F16: start frame, motion score (largest peak-to-peak of the motion columns) and label of each full window: quiet ones of
    a session are idle (0)."""
    w = Window.partitionBy("recording_id").orderBy("frame_idx").rowsBetween(0, length - 1)
    i = F.row_number().over(Window.partitionBy("recording_id").orderBy("frame_idx")) - 1
    score_ = F.greatest(*(F.max(c).over(w) - F.min(c).over(w) for c in motion)) if len(motion) > 1 else F.max(motion[0]).over(w) - F.min(motion[0]).over(w)
    s = features.select(*FRAME, "label", score_.alias("motion"), F.count("*").over(w).alias("n"), i.alias("i")).where((F.col("n") == length) & (F.col("i") % stride == 0))
    cut = s.groupBy("recording_id").agg(F.percentile("motion", F.lit(quantile)).alias("cut"))
    return s.join(cut, "recording_id").select(*FRAME, "motion", F.when(F.col("motion") >= F.col("cut"), F.col("label")).otherwise(0).alias("target"))


def normalisation(cells: DataFrame) -> DataFrame:
    """mean and population sd (1 below 1e-9) of each feature."""
    s = cells.groupBy("k").agg(F.avg("feature").alias("mean"), F.stddev_pop("feature").alias("sd"))
    return s.withColumn("sd", F.when(F.col("sd") < 1e-9, 1.0).otherwise(F.col("sd")))


def normalise(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """features in units of their sd; the statistics are one row a feature."""
    return cells.join(F.broadcast(stats), "k").select(*FRAME, "k", ((F.col("feature") - F.col("mean")) / F.col("sd")).alias("feature"))


def balance(targets: DataFrame, classes: int = 10) -> DataFrame:
    """count and balance weight n / (classes present * count) of each class."""
    n = targets.groupBy("target").agg(F.count("*").alias("n"))
    return n.select("target", "n", (F.sum("n").over(Window.partitionBy(F.lit(1))) / (F.count("*").over(Window.partitionBy(F.lit(1))) * F.col("n"))).alias("weight"))


def split_by_session(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """validation flag by session, so that overlapping windows never cross the split."""
    return rows.withColumn("validation", F.pmod(F.xxhash64("recording_id"), F.lit(1000)) < share * 1000)


def train(window_rows: DataFrame, hidden=(30, 60), classes: int = 10, seed: int = 7, rounds: int = 30):
    """fits a perceptron on (window, target) rows with pyspark.ml; classes are balanced by their weight as resampling."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    n = window_rows.groupBy("target").agg(F.count("*").alias("n"))
    # each class is repeated up to the size of the largest; the fraction goes by hash, the same in every run
    times = n.select("target", (F.max("n").over(Window.partitionBy(F.lit(1))) / F.col("n")).alias("times"))
    chance = F.pmod(F.xxhash64("recording_id", "frame_idx"), F.lit(10_000)) / 10_000 if "recording_id" in window_rows.columns else F.pmod(F.xxhash64("window"), F.lit(10_000)) / 10_000
    copies = F.floor("times").cast("int") + (chance < F.col("times") - F.floor("times")).cast("int")
    window_rows = window_rows.join(F.broadcast(times), "target").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))  # one row a class
    rows = window_rows.select(array_to_vector("window").alias("features"), F.col("target").cast("double").alias("label"))
    size = len(window_rows.select("window").first()["window"])
    return MultilayerPerceptronClassifier(layers=[size, *hidden, classes], seed=seed, maxIter=rounds).fit(rows)


def confusion(rows: DataFrame) -> DataFrame:
    """counts of (target, predicted) and the overall accuracy."""
    n = rows.groupBy("target", "predicted").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(1))
    return n.withColumn("accuracy", F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)).over(whole) / F.sum("n").over(whole))
