"""Multipath ("ghost") features and detectors (H): features once, every method a pair of columns, agreement by counting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dopplerlake.functions.scalars import azimuth_of, clip, half_even, range_of

FRAME = ["recording_id", "frame_idx"]
BINS = 16
METHODS: dict[str, Callable[[float], tuple[Column, Column]]] = {}


def register(name: str):
    """Adds a method: velocity resolution -> (score column, ghost column) over the feature columns."""

    def add(f):
        METHODS[name] = f
        return f

    return add


def trend(points: DataFrame) -> DataFrame:
    """H3: SNR above its range trend: 16 equal bins, medians of bins with 3 points or more, linear between their centres.

    All of it is windows over the recording, so that points are shuffled once at most.
    """
    whole, measured = Window.partitionBy("recording_id"), F.when(F.col("snr_db").isNotNull(), F.col("range_m"))
    p = points.withColumns({"lo": F.min(measured).over(whole), "hi": F.max(measured).over(whole), "overall": F.percentile("snr_db", F.lit(0.5)).over(whole)})
    width = (F.col("hi") - F.col("lo")) / BINS
    p = p.withColumn("b", F.when(F.col("hi") > F.col("lo"), clip(F.floor((F.col("range_m") - F.col("lo")) / width), 0, BINS - 1)))
    part = Window.partitionBy("recording_id", "b")
    p = p.withColumns({"m": F.percentile("snr_db", F.lit(0.5)).over(part), "known": F.count("snr_db").over(part)})
    knot = F.struct((F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / BINS).alias("x"), F.col("m").alias("m"))
    q = p.withColumn("knots", F.collect_set(F.when(F.col("b").isNotNull() & (F.col("known") >= 3), knot)).over(whole))
    below = F.array_max(F.filter("knots", lambda k: k["x"] <= F.col("range_m")))
    above = F.array_min(F.filter("knots", lambda k: k["x"] > F.col("range_m")))
    q = q.withColumns({"k0": below, "k1": above})
    inner = F.col("k0.m") + (F.col("k1.m") - F.col("k0.m")) * (F.col("range_m") - F.col("k0.x")) / (F.col("k1.x") - F.col("k0.x"))
    level = F.when(F.size("knots") < 2, F.col("overall")).otherwise(F.coalesce(inner, F.col("k0.m"), F.col("k1.m")))
    return q.withColumn("excess_db", F.coalesce(F.col("snr_db") - level, F.lit(0.0))).drop("lo", "hi", "overall", "b", "m", "known", "knots", "k0", "k1")


def features(points: DataFrame, range_bin: float, velocity_bin: float) -> DataFrame:
    """H1-H4: bins, co-cell count and secondary flag, SNR excess, and offsets from the frame's primary point. Points without a
    recording or a frame have none. Points that come partitioned by recording are not shuffled again."""
    p = points.withColumns({"range_m": range_of(), "azimuth_deg": azimuth_of()})
    p = p.withColumns({"range_bin": half_even(F.col("range_m") / range_bin), "doppler_bin": half_even(F.col("v") / velocity_bin)})
    frame, cell = Window.partitionBy(*FRAME), Window.partitionBy(*FRAME, "range_bin", "doppler_bin")
    p = p.withColumns({"q": F.percentile("snr_db", F.lit(0.75)).over(frame), "n": F.count("*").over(frame)})
    eligible = F.when((F.col("n") > 2) & F.col("q").isNotNull(), F.coalesce(F.col("snr_db") >= F.col("q"), F.lit(False))).otherwise(F.lit(True))
    p = p.withColumn("primary", F.min(F.when(eligible, F.struct("range_m", "point_idx", "azimuth_deg", "v"))).over(frame))
    p = p.withColumns({"d_range": F.col("range_m") - F.col("primary.range_m"), "d_azimuth": F.col("azimuth_deg") - F.col("primary.azimuth_deg"), "d_v": F.col("v") - F.col("primary.v")}).drop("q", "n", "primary")
    p = trend(p).where("recording_id is not null and frame_idx is not null")
    # the ordered window before the other, which is content with its order
    p = p.withColumn("secondary", F.row_number().over(cell.orderBy(F.desc_nulls_last("snr_db"), "point_idx")) > 1)
    return p.withColumn("cocell", F.count("*").over(cell))


@register("method0")
def _none(dv: float):
    return F.lit(0.0), F.lit(False)


@register("method1")
def _static(dv: float):
    ghost = F.abs("doppler_bin") <= 1
    return ghost.cast("double"), ghost


@register("method2")
def _secondary(dv: float):
    return F.when(F.col("secondary"), clip(F.col("cocell") / 3, 0.0, 1.0)).otherwise(0.0), F.col("secondary")


@register("method3")
def _weak_behind(dv: float):
    ghost = (F.col("excess_db") <= -3) & (F.col("d_range") >= 0.5)
    return F.when(ghost, clip(-F.col("excess_db") / 12, 0.0, 1.0)).otherwise(0.0), ghost


@register("method4")
def _mirror(dv: float):
    tolerance = max(3 * dv, 0.1)
    ghost = F.col("d_range").between(0.5, 6.0) & (F.abs("d_v") <= tolerance) & (F.abs("v") >= 0.15) & (F.abs("d_azimuth") >= 8)
    return F.when(ghost, 1 - F.abs("d_v") / tolerance).otherwise(0.0), ghost


@register("method5")
def _consensus(dv: float):
    voters = [METHODS[m](dv) for m in ("method2", "method3", "method4")]
    votes = sum((g.cast("int") for _, g in voters[1:]), voters[0][1].cast("int"))
    return clip(sum((s for s, _ in voters[1:]), voters[0][0]) / 3, 0.0, 1.0), votes >= 2


def labels(feature_rows: DataFrame, velocity_bin: float, methods: list[str] | None = None) -> DataFrame:
    """(point key, method, score, is_ghost) for all methods, in one projection."""
    made = []
    for m in methods or list(METHODS):
        score, ghost = METHODS[m](velocity_bin)
        made.append(F.struct(F.lit(m).alias("method"), score.alias("score"), ghost.alias("is_ghost")))
    return feature_rows.select(*FRAME, "point_idx", F.explode(F.array(*made)).alias("l")).select(*FRAME, "point_idx", "l.*")


def agreement(wide: DataFrame, methods: list[str]) -> DataFrame:
    """Jaccard of the tagged sets of each two methods, counted in one pass; null if neither tags a point."""
    pairs = [(a, b) for i, a in enumerate(methods) for b in methods[i:]]
    made = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) & F.col(b)).cast("long").alias("both"), (F.col(a) | F.col(b)).cast("long").alias("either")) for a, b in pairs))
    n = wide.select("recording_id", F.explode(made).alias("p")).groupBy("recording_id", "p.a", "p.b").agg(F.sum("p.both").alias("both"), F.sum("p.either").alias("either"))
    return n.withColumn("jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either")))


def widen(feature_rows: DataFrame, velocity_bin: float) -> DataFrame:
    """One boolean column a method."""
    return feature_rows.select("recording_id", *(METHODS[m](velocity_bin)[1].alias(m) for m in METHODS))


def tagged(label_rows: DataFrame) -> DataFrame:
    """Points tagged by each method and their share, before and after, with all recordings as a rollup row."""
    n = label_rows.rollup("method", "recording_id").agg(F.count("*").alias("n"), F.count_if("is_ghost").alias("tagged"), F.grouping("method").alias("g"))
    return n.where("g = 0").select("method", "recording_id", "n", "tagged", (F.col("n") - F.col("tagged")).alias("kept"), (F.col("tagged") / F.col("n")).alias("fraction"))


def tag_counts(velocity_bin: float) -> list[Column]:
    """Aggregates of feature rows: how many points there are, and how many of them each method tags."""
    return [F.count("*").alias("n"), *(F.count_if(ghost(velocity_bin)[1]).alias(m) for m, ghost in METHODS.items())]


def tagged_of(counts: DataFrame) -> DataFrame:
    """H13 from `tag_counts` of any parts of recordings: what `tagged` says of each recording, without one row a point and method."""
    s = counts.groupBy("recording_id").agg(*(F.sum(c).alias(c) for c in ("n", *METHODS)))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("tagged")) for m in METHODS)))
    rows = s.select("recording_id", "n", each.alias("e")).select("e.method", "recording_id", "n", "e.tagged")
    return rows.withColumns({"kept": F.col("n") - F.col("tagged"), "fraction": F.col("tagged") / F.col("n")})
