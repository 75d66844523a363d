"""Angle maps (B): zero-padded DFT over antennas in Arrow batches, marginals by hash aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = ["recording_id", "frame_idx"]
N = 64


def with_angle(maps: DataFrame) -> DataFrame:
    """B1: the angle of each bin of a map, asin(2k/N) degrees for k = 31..-31 in map order."""
    return maps.withColumn("angle_deg", F.degrees(F.asin(2 * (F.lit(N // 2 - 1) - F.col("angle_bin")) / N)))


def beamform(cells: DataFrame) -> DataFrame:
    """Magnitude of the 64-point DFT over antennas; shifted, first column dropped, reversed: 63 angle bins. One
    transform for an Arrow batch of (frame, range bin) rows, each with its few antennas as an array."""
    a = cells.groupBy(*FRAME, "range_bin").agg(F.collect_list(F.struct("ant", "re", "im")).alias("a"))
    keys = [*FRAME, "range_bin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                lists = part.column("a")
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                ant, re, im = (lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("ant", "re", "im"))
                z = np.zeros((part.num_rows, N), complex)
                np.add.at(z, (row, ant.astype(int) % N), np.nan_to_num(re) + 1j * np.nan_to_num(im))
                mags = np.abs(np.fft.fftshift(np.fft.fft(z, axis=1), axes=1))[:, 1:][:, ::-1]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * (N - 1), pa.int32()), pa.array(np.ascontiguousarray(mags).ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), flat], [*keys, "mags"])

    schema = T.StructType([*(a.schema[k] for k in keys), T.StructField("mags", T.ArrayType(T.DoubleType()))])
    made = a.mapInArrow(run, schema)
    return made.select(*keys, F.posexplode("mags").alias("angle_bin", "mag")).withColumn("angle_bin", F.col("angle_bin").cast("long"))


def azimuth_time(maps: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Sums over all range bins, or over first..last."""
    return (maps if first is None else maps.where(F.col("range_bin").between(first, last))).groupBy(*FRAME, "angle_bin").agg(F.sum("mag").alias("mag"))


def azimuth_time_following(maps: DataFrame, tracks: DataFrame, spacing: float, width: float = 0.5) -> DataFrame:
    """Sums over the range bins within `width` of the track of the frame."""
    near = maps.join(tracks.select(*FRAME, "range_m"), FRAME).where(F.abs(F.col("range_bin") * spacing - F.col("range_m")) <= width)
    return azimuth_time(near)


def beam_pattern(maps: DataFrame, centre: int, width: int = 1) -> DataFrame:
    """Beam pattern of each frame around one range bin."""
    return maps.where(F.abs(F.col("range_bin") - centre) <= width).groupBy(*FRAME, "angle_bin").agg(F.sum("mag").alias("mag"))


#: Which (transmitter, receiver) pairs make the azimuth array, by the number of transmitters and those that are on.
SYMBOLS = {
    (1, (0,)): ((0, 3), (0, 1)),
    (2, (0, 1)): ((1, 3), (1, 1)),
    (2, (1, 2)): ((2, 3), (2, 1), (1, 3), (1, 1)),
    (2, (0, 2)): ((2, 3), (2, 1)),
    (3, (0, 1, 2)): ((2, 3), (2, 1), (1, 3), (1, 1)),
}


def azimuth_symbols(cells: DataFrame, configs: DataFrame) -> DataFrame:
    """The antenna symbols that make the azimuth array, by the transmitters of each recording's configuration.

    `configs` holds recording_id, n_tx, n_rx, n_virtual and `slots` (the place of each transmitter in the order of firing, -1 if it
    does not fire). A pair's antenna is slot * n_rx + receiver; recordings with other sets of transmitters, or with a pair
    outside their antennas, have no azimuth array. `ant` is then the place in the array.
    """
    pair = lambda p: F.struct(F.lit(p[0]).alias("tx"), F.lit(p[1]).alias("rx"))
    known = F.create_map(*(x for (n, on), pairs in SYMBOLS.items() for x in (F.lit(f"{n}:{','.join(map(str, on))}"), F.array(*map(pair, pairs)))))
    on = F.filter(F.sequence(F.lit(0), F.size("slots") - 1), lambda i: F.get("slots", i) >= 0)
    key = F.concat(F.col("n_tx").cast("string"), F.lit(":"), F.array_join(on.cast("array<string>"), ","))
    places = F.transform(F.try_element_at(known, key), lambda p: F.get("slots", p["tx"]) * F.col("n_rx") + p["rx"])
    usable = configs.select("recording_id", "n_virtual", places.alias("places")).where(F.array_max("places") < F.col("n_virtual"))
    return cells.join(usable, "recording_id").withColumn("place", F.array_position("places", F.col("ant").cast("int")).cast("long") - 1).where("place >= 0").select(*FRAME, "range_bin", F.col("place").alias("ant"), "re", "im")


def grid_weights(spark, size: int, spacing: float, ranges: int) -> DataFrame:
    """Bilinear weights of (range, angle) cells for each cell of a size x size grid ahead of the radar; outside none."""
    top = (ranges - 1) * spacing
    g = spark.range(size * size).select((F.col("id") % size).alias("gx"), F.floor(F.col("id") / size).alias("gy"))
    g = g.withColumns({"x": -top + 2 * top * F.col("gx") / (size - 1), "y": top * F.col("gy") / (size - 1)})
    g = g.withColumn("h", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    g = g.withColumns({"r": F.col("h") / spacing, "u": (N // 2 - 1) - F.when(F.col("h") > 0, F.col("x") / F.col("h")).otherwise(0.0) * N / 2})
    g = g.where((F.col("r") <= ranges - 1) & F.col("u").between(0, N - 2))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    g = g.withColumns({"r0": F.floor("r"), "u0": F.floor("u")}).withColumn("c", corner)
    part = lambda v, lo, k: F.when(k == 1, v - lo).otherwise(1 - (v - lo))
    w = part(F.col("r"), F.col("r0"), F.col("c.a")) * part(F.col("u"), F.col("u0"), F.col("c.b"))
    return g.select("gx", "gy", (F.col("r0") + F.col("c.a")).alias("range_bin"), (F.col("u0") + F.col("c.b")).alias("angle_bin"), w.alias("weight")).where("weight > 0")


def to_cartesian(maps: DataFrame, weights: DataFrame) -> DataFrame:
    """Resamples each frame's range-azimuth map by a join with the (fixed, small) weight table."""
    return maps.join(F.broadcast(weights), ["range_bin", "angle_bin"]).groupBy(*FRAME, "gx", "gy").agg(F.sum(F.col("mag") * F.col("weight")).alias("mag"))
