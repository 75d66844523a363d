"""The fold contract: a table and a stream give the same rows, however rows are cut into files; sinks, counters and timers."""

import datetime as dt
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from dopplerlake.operators import gait, gesture
from dopplerlake.sources import captures, wire
from dopplerlake.sources import fixture_captures as made
from dopplerlake.streaming import apps, stateful
from dopplerlake.streaming.fold import APPS, Fold, register, run_batch, run_stream, source, staged

FRAMES = "recording_id long, frame_idx long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def streamed(spark, tmp_path, schema, files, fold, per_batch=1):
    """`files`: lists of rows, each one file, in the order they arrive."""
    path = str(tmp_path / f"in-{len(os.listdir(tmp_path))}")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    df = source(spark, path, spark.createDataFrame([], schema).schema, per_batch)
    return stateful.replay(run_stream(fold, df), str(tmp_path))


def cases():
    rng = np.random.default_rng(21)
    n = 60
    each = lambda f: [(rec, i, *f(rec, i)) for rec in (1, 2, 3) for i in range(n if rec < 3 else 11)]
    probs = each(lambda r, i: (rng.dirichlet([0.4] * 4).tolist(),))
    ranges = each(lambda r, i: (None if rng.random() < 0.3 else rng.uniform(0, 4, int(rng.integers(0, 4))).tolist(),))
    pairs = each(lambda r, i: (float(rng.normal()) if r != 2 else 1.0, float(rng.normal())))
    walk = each(lambda r, i: (i * 0.2, None if rng.random() < 0.2 else float(abs(np.sin(i / 4)) * rng.uniform(0, 1))))
    return {
        "decisions": (apps.decisions((0.5,) * 4, (2,) * 4, 6), f"{FRAMES}, probs array<double>", probs), "tracker": (apps.tracker(2, hold=2), f"{FRAMES}, ranges array<double>", ranges),
        "correlation": (apps.correlation(), f"{FRAMES}, azimuth double, doppler double", pairs), "walking": (apps.walking(), f"{FRAMES}, t double, v double", walk),
    }


@pytest.mark.parametrize("name", sorted(cases()))
def test_a_stream_gives_what_the_table_gives(spark, tmp_path, name):
    fold, schema, rows = cases()[name]
    assert name in APPS and APPS[name]().name == name
    want = rows_of(run_batch(fold, spark.createDataFrame(rows, schema).repartition(4)))
    assert len(want) >= len(rows)
    in_time = sorted(rows, key=lambda r: (r[1], r[0]))
    assert rows_of(streamed(spark, tmp_path, schema, [in_time[:50], in_time[50:51], in_time[51:]], fold)) == want
    # within a micro-batch rows may come in any order
    mixed = [in_time[90:][::-1], in_time[60:90], in_time[:60][::-1]]
    assert rows_of(streamed(spark, tmp_path, schema, mixed, fold, per_batch=3)) == want


def test_folds_equal_the_window_operators(spark):
    cs = cases()
    fold, schema, rows = cs["decisions"]
    df = spark.createDataFrame(rows, schema)
    assert rows_of(run_batch(fold, df)) == rows_of(gesture.debounce(df, (0.5,) * 4, (2,) * 4, 6).select("recording_id", "frame_idx", "state", "fired"))
    fold, schema, rows = cs["correlation"]
    got = {tuple(r[:2]): r[2] for r in run_batch(fold, spark.createDataFrame(rows, schema)).collect()}
    want = {(r["recording_id"], r["frame_idx"]): r["correlation"] for r in gesture.correlation(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got) and any(got.values())
    fold, schema, rows = cs["walking"]
    df = spark.createDataFrame(rows, schema)
    walks = {(r["recording_id"], f) for r in gait.segments(df, shortest=0.0).collect() for f in range(r["first"], r["last"] + 1)}
    assert {(r["recording_id"], r["frame_idx"]) for r in run_batch(fold, df).collect() if r["walking"]} == walks


def test_missing_rows_are_lost_and_null_recordings_are_kept(spark, tmp_path):
    fold, schema, rows = cases()["decisions"]
    gaps = [r for r in rows if r[0] == 1 and r[1] not in (5, 30, 31)]
    want = rows_of(run_batch(fold, spark.createDataFrame(gaps, schema)))
    assert rows_of(streamed(spark, tmp_path, schema, [gaps[:20], gaps[20:]], fold)) == want
    null = [(None, *r[1:]) for r in gaps]
    assert len(rows_of(run_batch(fold, spark.createDataFrame(gaps + null, schema)))) == 2 * len(want)
    assert run_batch(fold, spark.createDataFrame([], schema)).count() == 0


def test_own_applications_can_be_registered(spark, tmp_path):
    @register
    def total(start: float = 0.0) -> Fold:
        return Fold("total", ("frame_idx",), ("v",), "frame_idx long, total double", "sum double", lambda: (start,), lambda s, row: ((s[0] + row[1],), [(row[0], s[0] + row[1])]))

    try:
        rows = [(1, i, float(i)) for i in range(9)]
        got = rows_of(streamed(spark, tmp_path, f"{FRAMES}, v double", [rows[:4], rows[4:]], APPS["total"](10.0)))
        assert got == rows_of(run_batch(APPS["total"](10.0), spark.createDataFrame(rows, f"{FRAMES}, v double"))) and got[-1] == (1, 8, 46.0)
    finally:
        del APPS["total"]


def test_staged_tables_keep_the_order_of_a_recording(spark, tmp_path):
    df = spark.range(3000).selectExpr("id % 7 as recording_id", "id div 7 as frame_idx", "cast(id as double) as v")
    path = str(tmp_path / "staged")
    stream = staged(df, "frame_idx", path, pieces=4, files=3)
    assert spark.read.parquet(path).count() == 3000 and stream.isStreaming
    files = sorted((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: os.stat(f).st_mtime_ns)
    last = {}
    for f in files:
        for rec, low, high in spark.read.parquet(f).groupBy("recording_id").agg(F.min("frame_idx"), F.max("frame_idx")).collect():
            assert low > last.get(rec, -1)
            last[rec] = high


def capture(n=40, foreign=b""):
    out = b""
    for i in range(n):
        out += (foreign if i % 9 == 4 else b"") + made.pack(i, 1, [(1, bytes(16)), (7, bytes(4))] if i % 3 else [(99, b"xyz")])
    return out


def test_captures_divided_at_every_magic_word(spark, tmp_path):
    """Files of any size by the text reader: many splits, magic words inside packets, bytes that are no text."""
    inner = made.pack(77, 0, [])
    data = b"\xff\xfe\r\n" + capture(60, b"\x00\xe9\n") + made.pack(5, 0, [(9999, b"x" * 24 + inner + wire.MAGIC + b"y" * 60)]) + capture(20) + inner[:50]
    (tmp_path / "a.dat").write_bytes(data)
    (tmp_path / "b.dat").write_bytes(b"no packet at all\n" * 50)
    (tmp_path / "c.dat").write_bytes(capture(3))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = {"a": list(wire.chain(data)), "c": list(wire.chain(capture(3)))}
    try:
        for size in ("1m", "900", "100"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            pieces = captures.read_pieces(spark, str(tmp_path)).withColumn("recording_id", F.ascii(F.substring_index("path", "/", -1)).cast("long"))
            got = captures.cut(pieces).orderBy("recording_id", "frame_idx").collect()
            for name, packets in want.items():
                mine = [r for r in got if r["recording_id"] == ord(name)]
                assert [(r["byte_offset"], len(r["packet"]), r["skipped_before"]) for r in mine] == packets
                assert all(bytes(r["packet"]) == {"a": data, "c": capture(3)}[name][r["byte_offset"] : r["byte_offset"] + len(r["packet"])] for r in mine)
            bytes_ = {r["recording_id"]: r for r in captures.accounting(pieces).collect()}
            assert bytes_[ord("a")]["bytes_total"] == len(data) and bytes_[ord("b")]["bytes_skipped"] == 17 * 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_recording_with_a_third_of_all_rows_is_walked_in_pieces(spark):
    """Pieces of one long recording, of many short ones and of a table of cells give the packets of the whole bytes."""
    long, short = capture(4000, b"?!"), capture(5)
    cells = spark.createDataFrame([(0, long), *((k, short) for k in range(1, 30))], "recording_id long, content binary")
    got = captures.cut(captures.slices(cells, 777)).groupBy("recording_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("packet") + F.col("skipped_before")).alias("bytes")).collect()
    assert {r["recording_id"]: (r["n"], r["bytes"]) for r in got} == {0: (4000, len(long)), **{k: (5, len(short)) for k in range(1, 30)}}


def test_no_worker_holds_a_recording():
    """2.5 GB of one recording, as pieces made on the fly, pass through tasks of little memory: no cell or list of it exists."""
    code = """
import resource
from pyspark.sql import SparkSession, functions as F
from dopplerlake.sources import captures
from dopplerlake.sources import fixture_captures as made
spark = SparkSession.builder.master("local[1]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
packet = made.pack(1, 0, [(9, bytes(1 << 20))])
n = 2500
rows = spark.range(n).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("seq"), F.lit(packet).alias("bytes"))
from dopplerlake.streaming import apps
from dopplerlake.streaming.fold import run_batch
from dataclasses import replace
fold = apps.accounts()
got = run_batch(fold, rows).first()
assert got["bytes_in_frames"] == n * len(packet) and got["bytes_skipped"] == 0, got
print("BYTES", got["bytes_total"])
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=600)
    assert "BYTES" in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("BYTES")[1]) > 2.5e9


def chunks(spark, tmp_path, files=3):
    data = {1: capture(30, b"abc"), 2: capture(17)}
    rows = [(rec, k, 5.0 + k / 10, x[at : at + 100]) for rec, x in data.items() for k, at in enumerate(range(0, len(x), 100))]
    rows.sort(key=lambda r: (r[1], r[0]))
    schema = "recording_id long, seq long, ts double, bytes binary"
    path = str(tmp_path / "chunks")
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(path)
    return data, source(spark, path, spark.createDataFrame([], schema).schema, 1)


def test_raw_packets_and_their_index(spark, tmp_path):
    data, stream = chunks(spark, tmp_path)
    raw, index = stateful.dual_sink(stateful.reassemble(stream), str(tmp_path / "pair"))
    want = [(rec, i, at) for rec, x in data.items() for i, (at, _, _) in enumerate(wire.chain(x))]
    assert rows_of(raw.select("recording_id", "frame_idx", "byte_offset")) == sorted(want, key=str) == rows_of(index.select("recording_id", "frame_idx", "off"))
    r = {(x["recording_id"], x["frame_idx"]): x for x in index.collect()}
    assert r[1, 0]["t"] == 0.0 and r[1, 0]["n_pts"] == 0 and r[1, 0]["tlvs"] == [99] and r[1, 0]["anom"] == ["unknown_tlv_type (99, 3 bytes)"]
    assert r[1, 1]["n_pts"] == 1 and r[1, 1]["tlvs"] == [1, 7] and r[1, 1]["anom"] is None and r[2, 16]["frame"] == 16 and r[1, 29]["t"] > r[1, 3]["t"] >= 0
    assert len(os.listdir(tmp_path / "pair" / "commits")) >= 3


def test_a_batch_written_again_counts_once(spark, tmp_path):
    folder = str(tmp_path / "pair")
    packets = captures.cut(captures.slices(spark.createDataFrame([(1, capture(12))], "recording_id long, content binary")))
    packets = packets.withColumns({"length": F.octet_length("packet").cast("long"), "t": F.lit(0.0)})
    assert stateful.write_pair(packets, 0, folder)
    assert not stateful.write_pair(packets, 0, folder)
    # batch 1 broke off after its raw packets: unseen until it is written again, and then there once
    packets.write.parquet(f"{folder}/raw/batch=1")
    counts = lambda: [stateful.committed(spark, folder, part).count() for part in ("raw", "index")]
    assert counts() == [12, 12]
    assert stateful.write_pair(packets, 1, folder) and not stateful.write_pair(packets, 1, folder)
    assert counts() == [24, 24]


@pytest.mark.parametrize("cut", [[12], [1, 11], [4, 4, 4], [1] * 12])
def test_running_counters_equal_the_batch_after_any_split(spark, tmp_path, cut):
    schema = f"{FRAMES}, num_points long, skipped_before long"
    rows = [(k % 2, k // 2, k, k % 3) for k in range(12)]
    path = str(tmp_path / "frames")
    for n in np.cumsum([0, *cut[:-1]]):
        spark.createDataFrame(rows[n : n + cut[0] if len(cut) == 1 else n + cut[list(np.cumsum([0, *cut[:-1]])).index(n)]], schema).coalesce(1).write.mode("append").parquet(path)
    stream = source(spark, path, spark.createDataFrame([], schema).schema, 1)
    totals = stateful.running_counters(stream, str(tmp_path / "out"))
    assert totals.select("batch").distinct().count() == len(cut)
    assert rows_of(stateful.latest_counters(totals)) == rows_of(stateful.counters(spark.createDataFrame(rows, schema)))
    grows = [r[0] for r in totals.groupBy("batch").agg(F.sum("n_frames")).orderBy("batch").select("sum(n_frames)").collect()]
    assert grows == np.cumsum(cut).tolist()


START = dt.datetime(2025, 1, 1, 12)


class Clock:
    """A stream of reports to which files are added; its time is that of the newest report."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)
        self.schema = "recording_id long, ts timestamp, n_bytes long, failed boolean"

    def report(self, *rows):
        made_ = [(rec, START + dt.timedelta(seconds=at), n, failed) for rec, at, n, failed in rows]
        self.spark.createDataFrame(made_, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def turns(self):
        """Runs on from the checkpoint over what is new; all turns so far."""
        stream = source(self.spark, f"{self.folder}/in", self.spark.createDataFrame([], self.schema).schema, 1)
        told = stateful.health(stream)
        told.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/checkpoint").option("path", f"{self.folder}/out").trigger(availableNow=True).start().awaitTermination()
        rows = self.spark.read.schema(told.schema).parquet(f"{self.folder}/out").collect()
        return sorted((r["recording_id"], (r["at_ms"] - START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) / 1000, r["health"]) for r in rows)


def test_health_as_the_clock_advances(spark, tmp_path):
    clock = Clock(spark, tmp_path)
    clock.report((1, 0, None, False), (2, 0, 10, False), (9, 0, 1, False))
    assert clock.turns() == [(2, 0, "ok"), (9, 0, "ok")]
    clock.report((9, 2.5, 1, False))  # not three seconds yet
    assert clock.turns() == [(2, 0, "ok"), (9, 0, "ok")]
    clock.report((9, 3.5, 1, False))  # nothing came of 1 and 2, and their timers run out
    assert clock.turns() == [(1, 3, "no data"), (2, 0, "ok"), (2, 3, "stopped"), (9, 0, "ok")]
    clock.report((1, 4, 5, False), (9, 5, 1, True))  # late data, and a reader that says it failed
    assert clock.turns() == [(1, 3, "no data"), (1, 4, "ok"), (2, 0, "ok"), (2, 3, "stopped"), (9, 0, "ok"), (9, 5, "stopped")]
    clock.report((8, 20, 1, False))
    got = clock.turns()
    assert (1, 7, "stopped") in got and (8, 20, "ok") in got and len(got) == 8


def test_all_health_states_occur_in_the_query(spark):
    from dopplerlake.plans import registry

    got = registry.queries()["l05_health"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")).groupBy("health").count().collect()
    assert {r["health"] for r in got} == {"no data", "ok", "stopped"}
