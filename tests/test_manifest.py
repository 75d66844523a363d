"""Run manifests: what they hold, how they are stored, and that only the buckets asked for are read."""

from pyspark.sql import functions as F

from dopplerlake.sources import manifest as mf


def parts(spark):
    t = lambda schema, *rows: spark.createDataFrame(list(rows), "recording_id long, " + schema)
    return {
        "summary": t("n_frames long, n_points long, bytes_skipped long, resyncs long, frames_lost long, count_mismatches long, verdict string", (1, 10, 50, 7, 1, 2, 0, "not complete: bytes skipped"), (2, 5, 0, 0, 0, 0, 0, "complete")),
        "anomalies": t("anomaly string, n long", (1, "b", 2), (1, "a", 3)), "availability": t("has_points boolean, has_profile boolean, has_map boolean, tier string", (1, True, True, True, "B"), (2, False, True, False, "C+")),
        "geometry": t("range_bins long, range_spacing double", (1, 128, 0.1)), "metrics": t("cadence double, n_steps long", (1, 100.0, 4), (2, 0.0, 0)), "spectral": t("cadence_spectral double, confidence double", (1, 80.0, 0.5), (2, None, 0.0)),
        "tagged": t("method string, n long, tagged long, fraction double", (1, "method1", 50, 10, 0.2), (1, "method0", 50, 0, 0.0)), "quality": t("valid_fraction double", (1, 0.5)), "parameters": t("v_min double", (1, 0.3), (2, 0.2)),
    }


def test_one_row_a_run_and_bucket(spark, tmp_path):
    rows = mf.manifest(**parts(spark))
    read = mf.read_manifest(spark, mf.write_manifest(rows, str(tmp_path / "m")), rows.schema)
    got = {(r["recording_id"], r["bucket"]): r.asDict(recursive=True) for r in read.collect()}
    assert set(got) == {(1, mf.RAW), (2, mf.RAW), (1, "method0"), (1, "method1")}
    one = got[1, "method1"]
    assert one["integrity"] == {"lost_bytes": 7, "resyncs": 1, "frames_lost": 2, "count_mismatches": 0, "verdict": "not complete: bytes skipped", "anomalies": {"a": 3, "b": 2}}
    assert one["geometry"] == {"range_bins": 128, "range_spacing": 0.1} and one["parameters"] == {"v_min": 0.3} and one["payloads"] == ["points", "profile", "map"] and one["tier"] == "B"
    assert one["metrics"] == {"cadence": 100.0, "n_steps": 4, "cadence_spectral": 80.0, "confidence": 0.5, "cadence_gap_percent": 20.0}
    assert one["method"] == {"name": "method1", "n_points": 50, "n_tagged": 10, "fraction": 0.2} and got[1, mf.RAW]["method"] is None
    assert one["provenance"] == {"range_time": "range-Doppler map", "velocity_time": "following the track", "envelope": "map", "valid_fraction": 0.5}
    two = got[2, mf.RAW]
    assert two["provenance"]["range_time"] == "range profile" and two["provenance"]["velocity_time"] == "fixed region" and two["integrity"]["anomalies"] is None and two["metrics"]["cadence_gap_percent"] is None
    assert not two["geometry"] or two["geometry"]["range_bins"] is None
    assert {tuple(r) for r in rows.select("recording_id", "bucket", F.col("metrics.cadence")).collect()} == {tuple(r) for r in read.select("recording_id", "bucket", F.col("metrics.cadence")).collect()}


def test_only_the_buckets_asked_for_are_read(spark, tmp_path):
    rows = mf.manifest(**parts(spark))
    path = mf.write_manifest(rows, str(tmp_path / "m"))
    df = mf.read_manifest(spark, path, rows.schema, ["method1"])
    assert [r["method"]["name"] for r in df.collect()] == ["method1"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert "integrity_anomalies" in df.select(*mf.flat(df)).columns
