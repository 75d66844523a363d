"""Run manifests (S9): one row a run and bucket, joined from what the other operators say, kept as JSON by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

R = "recording_id"
#: The bucket of a run without any ghost method.
RAW = "raw_unfiltered"


def _struct(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return df.select(R, F.struct(*columns).alias(name))


def provenance(availability: DataFrame, quality: DataFrame) -> DataFrame:
    """Where each run's maps and envelope come from: the best payload for range-time, the track or a fixed region for
    velocity-time, and the map or the points for the envelope."""
    rows = availability.join(quality.select(R, "valid_fraction"), R, "left")
    rt = F.when(F.col("has_map"), "range-Doppler map").when(F.col("has_profile"), "range profile").otherwise("points")
    vt = F.when(F.coalesce(F.col("valid_fraction"), F.lit(0.0)) > 0, "following the track").otherwise("fixed region")
    return rows.select(R, F.struct(rt.alias("range_time"), vt.alias("velocity_time"), F.when(F.col("has_map"), "map").otherwise("points").alias("envelope"), "valid_fraction").alias("provenance"))


def manifest(summary: DataFrame, anomalies: DataFrame, availability: DataFrame, geometry: DataFrame, metrics: DataFrame, spectral: DataFrame, tagged: DataFrame, quality: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row for each run of `summary` (A1-A4, A15) in the raw bucket, and one for each ghost method that has tagged its points.

    `anomalies` (A7), `availability` (A16), `geometry` (S4, one row a run), `metrics` (G9), `spectral` (G10), `tagged` (H13: method,
    n, tagged, fraction), `quality` (A17) and `parameters` (any columns) are keyed by recording; what is not there is null.
    """
    totals = anomalies.groupBy(R).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("anomaly", "n")))).alias("anomalies"))
    integrity = summary.join(totals, R, "left").select(
        R, F.col("n_frames"), F.col("n_points"), F.struct(F.col("bytes_skipped").alias("lost_bytes"), "resyncs", "frames_lost", "count_mismatches", "verdict", "anomalies").alias("integrity"),
    )
    payloads = availability.select(R, "tier", F.array_compact(F.array(*(F.when(F.col(c), c.removeprefix("has_")) for c in availability.columns if c.startswith("has_")))).alias("payloads"))
    gap = F.when(F.col("cadence") > 0, 100 * F.abs(F.col("cadence") - F.col("cadence_spectral")) / F.col("cadence"))
    gait = metrics.join(spectral, R, "left").withColumn("cadence_gap_percent", gap)
    runs = integrity.join(payloads, R, "left").join(provenance(availability, quality), R, "left")
    for df, name in ((geometry, "geometry"), (gait, "metrics"), (parameters, "parameters")):
        runs = runs.join(_struct(df, name, [c for c in df.columns if c != R]), R, "left")
    made = F.struct(F.col("method").alias("bucket"), F.struct(F.col("method").alias("name"), F.col("n").alias("n_points"), F.col("tagged").alias("n_tagged"), "fraction").alias("method"))
    by_method = tagged.groupBy(R).agg(F.collect_list(made).alias("made"))
    raw = F.array(F.struct(F.lit(RAW).alias("bucket"), F.lit(None).cast("struct<name:string,n_points:bigint,n_tagged:bigint,fraction:double>").alias("method")))
    # each run is joined once, and stands in its buckets after that
    each = F.explode(F.coalesce(F.concat(raw, F.col("made")), raw))
    return runs.join(by_method, R, "left").select(*runs.columns, each.alias("each")).select(*runs.columns, "each.method", "each.bucket")


def write_manifest(rows: DataFrame, path: str) -> str:
    """One JSON row a run, a folder a bucket."""
    rows.write.partitionBy("bucket").json(path)
    return path


def read_manifest(spark: SparkSession, path: str, schema: T.StructType, buckets: list[str] | None = None) -> DataFrame:
    """Manifests of some buckets, or of all; folders of other buckets are not read."""
    rows = spark.read.schema(schema).json(path)
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def flat(rows: DataFrame) -> list[Column]:
    """All fields of a manifest as plain columns, nested names joined by an underscore; maps and lists as JSON text."""
    out: list[Column] = []
    for f in rows.schema:
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType:
                c = F.col(f"{f.name}.{g.name}")
                out.append((F.to_json(c) if isinstance(g.dataType, T.MapType | T.ArrayType) else c).alias(f"{f.name}_{g.name}"))
        else:
            out.append((F.to_json(f.name) if isinstance(f.dataType, T.MapType | T.ArrayType) else F.col(f.name)).alias(f.name))
    return out
