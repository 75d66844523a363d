"""Raw-sample maps (R) and diagnostics (D)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = ["recording_id", "frame_idx"]


@dataclass(frozen=True)
class Cube:
    """The samples of one frame, `adc`: chirp by chirp, in each all receivers, in each all samples (receiver and sample fastest).
    Complex samples have their imaginary parts in a second column `adc_im`."""

    chirps: int
    receivers: int
    samples: int

    @property
    def size(self) -> int:
        return self.chirps * self.receivers * self.samples


def _parts(frames: DataFrame) -> list[str]:
    return [c for c in ("adc", "adc_im") if c in frames.columns]


def mean_cubes(frames: DataFrame, cube: Cube) -> DataFrame:
    """Mean frame of each recording (recording_id, mean_adc, ...): each task adds up whole frames, and only sums are shuffled.
    A frame of another size is an error."""
    parts = _parts(frames)
    schema = T.StructType([T.StructField("recording_id", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(f"sum_{c}", T.ArrayType(T.DoubleType())) for c in parts)])

    def rows(sums: dict) -> pa.RecordBatch:
        made = [[None if v is None else v[1][k].tolist() for v in sums.values()] for k in range(len(parts))]
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([n for n, _ in sums.values()], pa.int64()), *(pa.array(m, pa.list_(pa.float64())) for m in made)], schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            data = [_matrix(b.column(c), cube) for c in parts]
            recs = np.array(b.column("recording_id").to_pylist())
            for rec in dict.fromkeys(recs.tolist()):
                here = recs == rec
                n, held = sums.get(rec, (0, [np.zeros(cube.size) for _ in parts]))
                sums[rec] = (n + int(here.sum()), [h + x[here].sum(axis=0) for h, x in zip(held, data)])
                if len(sums) * cube.size * 8 * len(parts) > 64 << 20:
                    yield rows(sums)
                    sums = {}
        if sums:
            yield rows(sums)

    def merge(pdf: pa.Table) -> pa.Table:
        n = pc.sum(pdf.column("n")).as_py()
        means = [(_matrix(pdf.column(f"sum_{c}").combine_chunks(), cube).sum(axis=0) / n).tolist() for c in parts]
        return pa.table([pdf.column("recording_id").slice(0, 1), pa.array([n], pa.int64()), *(pa.array([m], pa.list_(pa.float64())) for m in means)], names=schema.fieldNames())

    partial = frames.select("recording_id", *parts).mapInArrow(run, schema)
    return partial.groupBy("recording_id").applyInArrow(merge, schema).select("recording_id", *(F.col(f"sum_{c}").alias(f"mean_{c}") for c in parts))


def remove_background(frames: DataFrame, background: DataFrame, pairs: DataFrame, cube: Cube) -> DataFrame:
    """Takes the mean frame of another recording, an empty room, off each frame, sample by sample for every chirp and receiver.

    `pairs` names the background of each recording (recording_id, background_id); recordings without one are not there. Where
    the two have different numbers of frames, both count only as many as the shorter has, from their start.
    """
    n = lambda df, key, name: df.groupBy("recording_id").agg(F.count("*").alias(name)).withColumnRenamed("recording_id", key)
    both = pairs.join(n(frames, "recording_id", "own"), "recording_id").join(n(background, "background_id", "other"), "background_id").select("recording_id", "background_id", F.least("own", "other").alias("kept"))
    place = lambda df: df.withColumn("__i", F.row_number().over(Window.partitionBy("recording_id").orderBy("frame_idx")))
    parts = _parts(frames)
    rooms = place(background).withColumnRenamed("recording_id", "background_id").join(both, "background_id").where(F.col("__i") <= F.col("kept")).select("recording_id", "frame_idx", *parts)
    walks = place(frames).join(both, "recording_id").where(F.col("__i") <= F.col("kept")).drop("__i", "kept", "background_id")
    less = lambda c: F.zip_with(c, f"mean_{c}", lambda x, m: x - m).alias(c)
    return walks.join(mean_cubes(rooms, cube), "recording_id").select(*(less(c) if c in parts else c for c in frames.columns))


def frames_of(cells: DataFrame) -> DataFrame:
    """Samples of a frame (chirp, rx, sample, val) in one array."""
    a = F.array_sort(F.collect_list(F.struct("chirp", "rx", "sample", "val")))
    return cells.groupBy(*FRAME).agg(F.transform(a, lambda s: s["val"]).alias("adc"))


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _matrix(column: pa.Array, cube: Cube) -> np.ndarray:
    """Rows of a list column as a matrix (frames, samples of a cube); missing samples are zero."""
    if len(column) and set(np.diff(column.offsets.to_numpy()).tolist()) != {cube.size}:
        raise ValueError(f"a frame does not hold {cube.chirps} x {cube.receivers} x {cube.samples} samples")
    return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, cube.size)


def _spectra(batch: pa.RecordBatch, parts: list[str], cube: Cube, rx: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, range spectra (frames, chirps, size) of one receiver): periodic Hann, zero-padded to `size`; some frames at a time."""
    step = max(1, (4 << 20) // (cube.chirps * size))
    for at in range(0, batch.num_rows, step):
        data = [_matrix(batch.column(c).slice(at, step), cube).reshape(-1, cube.chirps, cube.receivers, cube.samples)[:, :, rx] for c in parts]
        x = data[0] if len(data) == 1 else data[0] + 1j * data[1]
        yield at, np.fft.fft(x * _hann(cube.samples), size, axis=2)


def _doppler(column: np.ndarray, size: int) -> np.ndarray:
    return np.abs(np.fft.fftshift(np.fft.fft(column * _hann(column.shape[1]), size, axis=1), axes=1))


def _kernel(frames: DataFrame, cube: Cube, rx: int, size: int, columns: list[str], made) -> DataFrame:
    """(frame, bin, value): `made(spectra, extra columns)` gives one array a frame."""
    parts = _parts(frames)
    if not 0 <= rx < cube.receivers:
        raise ValueError(f"receiver {rx} of {cube.receivers}")
    keys = [*FRAME]
    schema = T.StructType([*(frames.schema[k] for k in keys), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, s in _spectra(b, parts, cube, rx, size):
                v = made(s, *(b.column(c).slice(at, len(s)).to_numpy(zero_copy_only=False) for c in columns))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(np.ascontiguousarray(v).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(s)) for k in keys), flat], [*keys, "v"])

    return frames.select(*keys, *parts, *columns).mapInArrow(run, schema).select(*keys, F.posexplode("v").alias("bin", "value"))


def range_time(frames: DataFrame, cube: Cube, rx: int = 0, size: int = 1024) -> DataFrame:
    """R2: range transform of one receiver and its mean magnitude over chirps."""
    return _kernel(frames, cube, rx, size, [], lambda s: np.abs(s).mean(axis=1))


def velocity_time(frames: DataFrame, cube: Cube, rx: int = 0, size: int = 1024, first: int = 0, last: int | None = None, dopplers: int | None = None) -> DataFrame:
    """Doppler spectrum at the strongest range bin of first..last of each frame (ties: the nearer), over `dopplers` bins."""

    def made(s: np.ndarray) -> np.ndarray:
        gate = s[:, :, first : None if last is None else last + 1]
        at = np.round(np.abs(gate).mean(axis=1), 9).argmax(axis=1)
        return _doppler(np.take_along_axis(gate, at[:, None, None], axis=2)[:, :, 0], dopplers or cube.chirps)

    return _kernel(frames, cube, rx, size, [], made)


def velocity_time_following(frames: DataFrame, tracks: DataFrame, cube: Cube, spacing: float, rx: int = 0, size: int = 1024, width: float = 0.25, dopplers: int | None = None) -> DataFrame:
    """Doppler spectrum of the coherent sum of the range bins around the track of each frame: the bin nearest to it and
    `width` / `spacing` (rounded, at least one) to either side, inside the axis. Frames without a track are not there."""
    rows = frames.join(tracks.where("range_m is not null").select(*FRAME, "range_m"), FRAME)
    half = max(1, math.floor(width / spacing + 0.5))

    def made(s: np.ndarray, at: np.ndarray) -> np.ndarray:
        nearest = np.abs(np.arange(size)[None, :] * spacing - at[:, None]).argmin(axis=1)
        near = np.abs(np.arange(size)[None, :] - nearest[:, None]) <= half
        return _doppler((s * near[:, None, :]).sum(axis=2), dopplers or cube.chirps)

    return _kernel(rows, cube, rx, size, ["range_m"], made)


def processing(stats: DataFrame, at_risk: float = 1.0) -> DataFrame:
    """Mean load, smallest margin between frames (ms), and whether it falls below `at_risk`."""
    s = stats.groupBy("recording_id").agg(F.avg("load").alias("mean_load"), F.min(F.col("margin_us") / 1000).alias("min_margin_ms"))
    return s.withColumn("at_risk", F.col("min_margin_ms") < at_risk)


def temperatures(rows: DataFrame, sensors: list[str]) -> DataFrame:
    """One row a frame and sensor."""
    return rows.unpivot(FRAME, sensors, "sensor", "celsius")


def rolling_load(stats: DataFrame, frames: int = 100) -> DataFrame:
    """D3: mean load of the last `frames` frames."""
    w = Window.partitionBy("recording_id").orderBy("frame_idx").rowsBetween(-(frames - 1), 0)
    return stats.select(*FRAME, F.avg("load").over(w).alias("rolling_load"))
