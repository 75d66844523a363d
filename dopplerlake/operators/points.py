"""Point-cloud rows (P): flattening, geometry, time bases, gates, spatial background removal, accumulation, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dopplerlake.functions.scalars import azimuth_of, elevation_of, half_even, range_of

FRAME = ["recording_id", "frame_idx"]


def flatten(frames: DataFrame) -> DataFrame:
    """One row a point from `points` and `side` arrays; side information counts only if it has as many entries."""
    rows = frames.select(*FRAME, F.posexplode("points").alias("point_idx", "p"), F.when(F.size("side") == F.size("points"), F.col("side")).alias("side"))
    side = lambda c: F.get("side", F.col("point_idx"))[c].alias(c)
    return rows.select(*FRAME, F.col("point_idx").cast("long").alias("point_idx"), "p.*", side("snr_db"), side("noise_db"))


def nest(points: DataFrame) -> DataFrame:
    """Rows back to frames with arrays in wire order (the inverse of P1, for storing and tests)."""
    every = F.array_sort(F.collect_list(F.struct("point_idx", "x", "y", "z", "v", "snr_db", "noise_db")))
    return points.groupBy(*FRAME).agg(every.alias("a")).select(
        *FRAME, F.transform("a", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["z"].alias("z"), r["v"].alias("v"))).alias("points"),
        F.transform("a", lambda r: F.struct(r["snr_db"].alias("snr_db"), r["noise_db"].alias("noise_db"))).alias("side"),
    )


def geometry(points: DataFrame) -> DataFrame:
    """Range, azimuth, elevation, and peak value where side information is there."""
    return points.withColumns({"range_m": range_of(), "azimuth_deg": azimuth_of(), "elevation_deg": elevation_of(), "peak_db": F.col("snr_db") + F.col("noise_db")})


def time_base(frames: DataFrame, period: float) -> DataFrame:
    """Seconds from the frame counter, or from the row index where the counter ever steps back."""
    w, whole = Window.partitionBy("recording_id").orderBy("frame_idx"), Window.partitionBy("recording_id")
    step = frames.withColumn("step", F.col("frame_number") - F.lag("frame_number").over(w))
    back, first = F.min("step").over(whole) < 0, F.min_by("frame_number", "frame_idx").over(whole)
    return step.withColumn("t", F.when(F.coalesce(back, F.lit(False)), F.col("frame_idx")).otherwise(F.col("frame_number") - first) * period).drop("step")


def unwrap_clock(frames: DataFrame, hertz: float = 200e6) -> DataFrame:
    """P5: seconds from a 32-bit cycle counter; a fall from above 2^31 is a rollover."""
    w = Window.partitionBy("recording_id").orderBy("frame_idx")
    before = F.lag("cycles").over(w)
    turned = F.when((F.col("cycles") < before) & (before > 2**31), 1).otherwise(0)
    return frames.withColumn("turned", turned).withColumn("hw_t", (F.col("cycles") + F.sum("turned").over(w) * 2**32) / hertz).drop("turned")


def gate(points: DataFrame, near: float = 0.5, far: float = 8.0, snr: float = 10.0, speed: float = 0.15, snr_unit: float = 0.1) -> DataFrame:
    """Region, SNR and speed gate. `snr` is in units of `snr_unit` dB."""
    r = range_of()
    return points.where((r >= near) & (r <= far) & (F.round(F.col("snr_db") / snr_unit) >= snr) & (F.abs("v") >= speed))


def notch(points: DataFrame, resolution: float, k: int = 0) -> DataFrame:
    """Drops points within k bins of zero Doppler (half-even bins)."""
    return points.where(F.abs(F.rint(F.col("v") / resolution)) > k)


def keep(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points that no label calls a ghost; every point needs a label, or the mask is incomplete and the job fails."""
    keys = [*FRAME, "point_idx"]
    joined = points.join(labels.select(*keys, "is_ghost"), keys, "left")
    checked = F.when(F.col("is_ghost").isNull(), F.raise_error(F.lit("a point has no label")).cast("boolean")).otherwise(F.col("is_ghost"))
    return joined.where(~checked).drop("is_ghost")


def ranked(points: DataFrame) -> DataFrame:
    """Points with their place by SNR in their frame, from 1; ties and missing SNR by wire order."""
    w = Window.partitionBy(*FRAME).orderBy(F.desc_nulls_last("snr_db"), "point_idx")
    return points.withColumn("place", F.row_number().over(w))


def strongest(points: DataFrame, n: int = 5) -> DataFrame:
    """The n points of highest SNR of each frame; ties and missing SNR by wire order."""
    return ranked(points).where(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def subtract_background(points: DataFrame, background: DataFrame, distance: float = 0.25) -> DataFrame:
    """P10: drops points with a background point of their recording within `distance`.

    A grid turns the search into an equi-join: each background point stands in every cell that its surroundings reach. Cells are
    twelve distances wide, which makes 1.6 copies of a point, where cells of one distance make 27 and fill the disk with them.
    """
    cell = lambda c: F.floor(c / (12 * distance))
    reach = distance * (1 + 1e-6)  # a little more, since a difference that rounds to `distance` counts
    near = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
    b = background.select(F.col("recording_id").alias("r"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    b = b.withColumn("cx", near("bx")).withColumn("cy", near("by")).withColumn("cz", near("bz"))
    b = b.repartition("r", "cx", "cy", "cz").distinct()  # in this order one shuffle serves both this and the join
    dx, dy, dz = (F.col(c) - F.col(f"b{c}") for c in "xyz")
    met = (F.col("recording_id") == F.col("r")) & (cell(F.col("x")) == F.col("cx")) & (cell(F.col("y")) == F.col("cy")) & (cell(F.col("z")) == F.col("cz")) & (F.sqrt(dx * dx + dy * dy + dz * dz) <= distance)
    return points.join(b, met, "left_anti")


def accumulate(points: DataFrame, frames: int, last: int) -> DataFrame:
    """Each point in every display frame from its own to `frames` - 1 later, up to frame `last` of a recording."""
    shown = F.sequence(F.col("frame_idx"), F.least(F.col("frame_idx") + frames - 1, F.lit(last)))
    return points.withColumn("shown_at", F.explode(shown))


def accumulated(points: DataFrame, frames: int, last: int) -> DataFrame:
    """Number, mean x and largest y of the points that each frame up to `last` shows, its own and those of the `frames` - 1
    before; frames that show none are not there. Points are added up by frame first, and only these sums are shown in later ones."""
    own = points.groupBy(*FRAME).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.max("y").alias("y"))
    shown = accumulate(own, frames, last).groupBy("recording_id", "shown_at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.max("y").alias("max_y"))
    return shown.select("recording_id", "shown_at", "n", (F.col("x") / F.col("n")).alias("mean_x"), "max_y")


def mark_static(profile: DataFrame, points: DataFrame, range_bin: float, velocity_bin: float, bins: int) -> DataFrame:
    """Profile cells in which a point of zero Doppler was detected, and how many."""
    hits = points.select(*FRAME, half_even(range_of() / range_bin).alias("range_bin"), half_even(F.col("v") / velocity_bin).alias("d"))
    hits = hits.where((F.col("d") == 0) & F.col("range_bin").between(0, bins - 1)).groupBy(*FRAME, "range_bin").agg(F.count("*").alias("n_static"))
    return profile.join(hits, [*FRAME, "range_bin"])


def density(points: DataFrame, x: Column, y: Column, nx: int, ny: int) -> DataFrame:
    """Counts on an nx by ny grid over each recording's own extent; the last bin is closed, a flat axis gets width 1."""
    p = points.select("recording_id", x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    e = p.groupBy("recording_id").agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    p = p.join(e, "recording_id")

    def bin_of(c: str, n: int) -> Column:
        lo = F.when(F.col(f"lo{c}") == F.col(f"hi{c}"), F.col(f"lo{c}") - 0.5).otherwise(F.col(f"lo{c}"))
        hi = F.when(F.col(f"lo{c}") == F.col(f"hi{c}"), F.col(f"hi{c}") + 0.5).otherwise(F.col(f"hi{c}"))
        return F.least(F.floor((F.col(c) - lo) / (hi - lo) * n), F.lit(n - 1)).cast("long")

    return p.groupBy("recording_id", bin_of("x", nx).alias("bx"), bin_of("y", ny).alias("by")).agg(F.count("*").alias("n"))


def figure_rows(points: DataFrame) -> DataFrame:
    """The columns that time, range and angle views draw, in long form."""
    g = geometry(points)
    stack = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("range_m", "v", "snr_db", "azimuth_deg", "elevation_deg"))), F.array("range_m", "v", "snr_db", "azimuth_deg", "elevation_deg")))
    return g.select(*FRAME, "point_idx", "t", stack.alias("view", "value")).where("value is not null")


def axis_limit(points: DataFrame) -> DataFrame:
    """max(2, 1.15 p99.5(range)) of each recording, 10 without points."""
    p = F.percentile(range_of(), F.lit(0.995))
    return points.groupBy("recording_id").agg(F.coalesce(F.greatest(F.lit(2.0), p * 1.15), F.lit(10.0)).alias("limit_m"))
