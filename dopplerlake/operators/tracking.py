"""Target tracking (T): candidates by windows in Spark, association in frame order by a small step function.

Association is sequential within a recording, so Spark partitions and sorts, and a task streams over its rows with the
state of one recording and the rows of one frame in memory, however long the recording is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dopplerlake.functions.scalars import amplitude, range_of
from dopplerlake.streaming.apps import tracker
from dopplerlake.streaming.fold import run_batch

R, FRAME = "recording_id", ["recording_id", "frame_idx"]


def peaks(profile: DataFrame, n: int, separation: int) -> DataFrame:
    """Up to n largest positive cells of each frame, at least `separation` bins apart, by bin. Array expressions, no kernel.

    After each pick the cells nearer than `separation` are zeroed; ties go to the lower bin.
    """
    a = profile.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("cells")).select(*FRAME, F.transform("cells", lambda c: F.coalesce(c["value"], F.lit(0.0))).alias("v"), F.array().cast("array<int>").alias("picked"))
    for _ in range(n):
        top = F.array_max("v")
        at = F.when(top > 0, F.array_position("v", top).cast("int") - 1)
        a = a.withColumn("at", at).select(
            *FRAME, F.when(F.col("at").isNull(), F.col("v")).otherwise(F.transform("v", lambda x, i: F.when(F.abs(i - F.col("at")) < separation, 0.0).otherwise(x))).alias("v"),
            F.when(F.col("at").isNull(), F.col("picked")).otherwise(F.array_append("picked", F.col("at"))).alias("picked"),
        )
    return a.select(*FRAME, F.explode(F.sort_array(F.col("picked").cast("array<long>"))).alias("bin"))


def best_match(distance: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of rows to columns of least total distance (few rows; exhaustive)."""
    n, m = distance.shape
    if n <= m:
        best = min(permutations(range(m), n), key=lambda c: sum(distance[i, j] for i, j in enumerate(c)))
        return list(enumerate(best))
    best = min(permutations(range(n), m), key=lambda r: sum(distance[i, j] for j, i in enumerate(r)))
    return [(i, j) for j, i in enumerate(best)]


def greedy_match(distance: np.ndarray) -> list[tuple[int, int]]:
    """Nearest pair first, each row and column once; ties by row, then column."""
    out, d = [], distance.copy()
    while d.size and np.isfinite(d).any():
        i, j = np.unravel_index(np.argmin(d), d.shape)
        out.append((int(i), int(j)))
        d[i, :], d[:, j] = np.inf, np.inf
    return out


def in_order(rows: DataFrame, within: str, make: Callable[[], Callable[[dict[str, np.ndarray]], list[tuple]]], schema: str) -> DataFrame:
    """One pass over each recording by frame (and `within` it): `make()` gives a recording's step, which takes a frame's columns
    and gives output rows without the two key columns."""
    ordered = rows.repartition(R).sortWithinPartitions(R, "frame_idx", within)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, recording, step = None, None, None

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal recording, step
            out, columns = [], {c: pdf[c].to_numpy() for c in pdf.columns}
            recs, frames = columns[R], columns["frame_idx"]
            cuts = [0, *(np.flatnonzero((recs[1:] != recs[:-1]) | (frames[1:] != frames[:-1])) + 1).tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if recs[a] != recording:
                    recording, step = recs[a], make()
                out += [(recs[a], frames[a], *row) for row in step({c: v[a:b] for c, v in columns.items()})]
            return pd.DataFrame(out, columns=names)

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            if not len(pdf):
                continue
            open_ = (pdf[R] == pdf[R].iloc[-1]) & (pdf["frame_idx"] == pdf["frame_idx"].iloc[-1])
            held = pdf[open_]
            yield walk(pdf[~open_])
        if held is not None:
            yield walk(held)

    return ordered.mapInPandas(run, schema)


TRACK = "recording_id long, frame_idx long, target long, range_m double, coasted boolean"


def track_maps(candidates: DataFrame, spine: DataFrame, targets: int = 1, jump: float = 0.6, coast: int = 10, optimal: bool = False) -> DataFrame:
    """Follows peaks (recording_id, frame_idx, range_m) through all frames: nearest assignment (greedy, or of least total),
    no jump beyond `jump`, the last range held for `coast` frames. A recording's first frame seeds the targets, nearest first;
    those that it has no peak for stay without."""
    rows = spine.select(*FRAME).join(candidates.select(*FRAME, "range_m"), FRAME, "left")

    def make():
        state: list[list] = []

        def step(g: dict[str, np.ndarray]) -> list[tuple]:
            found = g["range_m"][~np.isnan(g["range_m"])]
            if not state:
                state.extend([float(found[i]) if i < len(found) else None, 0] for i in range(targets))
                return [(i, x, False) for i, (x, _) in enumerate(state)]
            alive, pairs = [i for i, s in enumerate(state) if s[0] is not None], {}
            if len(found) and alive:
                d = np.abs(np.array([state[i][0] for i in alive])[:, None] - found[None, :])
                if not optimal:
                    d[d > jump] = np.inf
                pairs = {alive[i]: j for i, j in (best_match(d) if optimal else greedy_match(d)) if d[i, j] <= jump}
            for i in alive:
                s = state[i]
                s[:] = [float(found[pairs[i]]), 0] if i in pairs else [s[0], s[1] + 1]
            return [(i, x if missed <= coast else None, x is not None and 0 < missed <= coast) for i, (x, missed) in enumerate(state)]

        return step

    return in_order(rows, "range_m", make, TRACK)


def strongest_candidates(points: DataFrame, targets: int = 1, slowest: float | None = None, apart: float = 0.4) -> DataFrame:
    """Up to `targets` ranges of each frame's strongest points by weight 10^(SNR/20) (ties: wire order), each at least
    `apart` from those before it, in that order; with an optional speed floor. All points of a frame stand to choose."""
    p = points if slowest is None else points.where(F.abs("v") >= slowest)
    found = F.struct(amplitude(F.col("snr_db")).alias("weight"), (-F.col("point_idx")).alias("order"), range_of().alias("range_m"))
    a = p.groupBy(*FRAME).agg(F.collect_list(found).alias("left")).withColumn("ranges", F.array().cast("array<double>"))
    for _ in range(targets):
        a = a.withColumn("top", F.array_max("left")["range_m"])
        a = a.select(
            *FRAME, F.when(F.col("top").isNull(), F.col("left")).otherwise(F.filter("left", lambda q: F.abs(q["range_m"] - F.col("top")) >= apart)).alias("left"),
            F.when(F.col("top").isNull(), F.col("ranges")).otherwise(F.array_append("ranges", F.col("top"))).alias("ranges"),
        )
    return a.select(*FRAME, "ranges")


def track_points(candidates: DataFrame, spine: DataFrame, targets: int = 1, jump: float = 0.6, hold: int = 10) -> DataFrame:
    """The tracker over the candidates (`ranges`) of every frame of the spine: range (measured, or held and then `coasted`)
    of each target."""
    return run_batch(tracker(targets, jump, hold), spine.select(*FRAME).join(candidates.select(*FRAME, "ranges"), FRAME, "left"))


def fill_track(tracks: DataFrame, edge: str = "clamp") -> DataFrame:
    """T4: gaps of a track filled linearly, ends held (clamp) or continued (linear); needs two values, else left as it is."""
    keys = [c for c in (R, "target") if c in tracks.columns]
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("range_m").isNotNull(), F.struct(F.col("frame_idx").alias("i"), F.col("range_m").alias("v")))
    nth = lambda k: F.nth_value(at, k, ignoreNulls=True).over(whole)
    reverse = Window.partitionBy(*keys).orderBy(F.desc("frame_idx")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = lambda k: F.nth_value(at, k, ignoreNulls=True).over(reverse)
    a, b = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
    line = lambda p, q: p["v"] + (q["v"] - p["v"]) * (F.col("frame_idx") - p["i"]) / (q["i"] - p["i"])
    ends = (b["v"], a["v"]) if edge == "clamp" else (line(nth(1), nth(2)), line(back(2), back(1)))
    filled = F.when(a.isNull(), ends[0]).when(b.isNull(), ends[1]).otherwise(line(a, b))
    value = F.when(F.col("range_m").isNotNull(), F.col("range_m")).when(F.count("range_m").over(whole) >= 2, filled)
    return tracks.withColumn("filled_m", value).withColumn("interpolated", F.col("range_m").isNull() & F.col("filled_m").isNotNull())


def two_means(xyz: np.ndarray) -> np.ndarray:
    """Centres of two clusters: from the farthest pair of points, by means until no point changes sides (ties to the second)."""
    d = np.sqrt(((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(axis=2))
    i, j = np.unravel_index(np.argmax(d), d.shape)
    centres, side = xyz[[i, j]], None
    while True:
        near = np.linalg.norm(xyz - centres[0], axis=1) < np.linalg.norm(xyz - centres[1], axis=1)
        if side is not None and (near == side).all() or near.all() or not near.any():
            return centres
        centres, side = np.stack([xyz[near].mean(axis=0), xyz[~near].mean(axis=0)]), near


def separate_two(points: DataFrame, gate: float = 0.75, apart: float = 0.5, drop: int = 10) -> DataFrame:
    """Splits points between two moving centroids in space: the nearest one within `gate`, ties to the second; a centroid is
    the mean of its points of the last frame that had any, and is forgotten after more than `drop` frames of points without its own.

    While either centroid is missing, a frame of two or more points seeds both by its two clusters if their centres are more
    than `apart` from each other; points of such a frame, and points of neither person, are of person -1.
    """
    rows = points.select(*FRAME, "point_idx", "x", "y", "z")

    def make():
        centres, missed = [None, None], [0, 0]

        def step(g: dict[str, np.ndarray]) -> list[tuple]:
            xyz = np.stack([g["x"], g["y"], g["z"]], axis=1)
            who = np.full(len(xyz), -1)
            if centres[0] is None or centres[1] is None:
                if len(xyz) >= 2:
                    a, b = two_means(xyz)
                    if np.linalg.norm(a - b) > apart:
                        centres[:] = [a, b]
            else:
                first, second = (np.linalg.norm(xyz - c, axis=1) for c in centres)
                who[(first < second) & (first < gate)] = 0
                who[(second <= first) & (second < gate)] = 1
                for k in (0, 1):
                    mine = xyz[who == k]
                    if len(mine):
                        centres[k], missed[k] = mine.mean(axis=0), 0
                    else:
                        missed[k] += 1
                    if missed[k] > drop:
                        centres[k] = None
            return list(zip(g["point_idx"].tolist(), who.tolist()))

        return step

    return in_order(rows, "point_idx", make, "recording_id long, frame_idx long, point_idx long, person long")
