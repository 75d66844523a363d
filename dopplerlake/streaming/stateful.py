"""Streams (L): replays, the raw and index sink, running counters, and health by timers; applications are in `apps`."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dopplerlake.sources.captures import header, shred

from . import apps
from .fold import run_stream


def _run(stream: DataFrame, base: str, mode: str, to: Callable) -> None:
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    to(w).start().awaitTermination()


def replay(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """L2, L3: runs a stream over all that is there into Parquet, with its checkpoint beside it, and reads the result."""
    spark, base = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    _run(stream, base, mode, lambda w: w.format("parquet").option("path", f"{base}/rows"))
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def reassemble(chunks: DataFrame) -> DataFrame:
    """Packets from byte chunks (recording_id, seq, ts, bytes); a partial tail waits in the state, lost bytes are counted."""
    return run_stream(apps.packets(), chunks if "ts" in chunks.columns else chunks.withColumn("ts", F.lit(None).cast("double")))


def online_decisions(probs: DataFrame, thresholds=apps.PROBABILITY, votes=apps.VOTES, length: int = apps.LENGTH) -> DataFrame:
    """L4: debounced state and events of each frame, as the batch operator gives them."""
    return run_stream(apps.decisions(thresholds, votes, length), probs)


def online_correlation(features: DataFrame, length: int = apps.CORRELATED) -> DataFrame:
    """L4: correlation of azimuth and Doppler over the last frames, kept as two short arrays a recording."""
    return run_stream(apps.correlation(length), features)


def online_track(candidates: DataFrame, targets: int = 1, jump: float = 0.6, hold: int = 10) -> DataFrame:
    """The point tracker of the batch operator in a stream."""
    return run_stream(apps.tracker(targets, jump, hold), candidates)


def index_rows(packets: DataFrame) -> DataFrame:
    """L2: one row a packet: time since the first, header fields, place, points, payload types in order, anomalies (null if none)."""
    p = header(shred(packets))
    n = F.filter("tlvs", lambda x: x["type"] == 1)
    return p.select(
        "recording_id", "frame_idx", "t", F.col("frame_number").alias("frame"), F.col("sub_frame").alias("sub"), "cycles", F.col("byte_offset").alias("off"),
        F.coalesce(F.floor(F.get(n, F.lit(0))["length"] / 16), F.lit(0)).alias("n_pts"), F.transform("tlvs", lambda x: x["type"]).alias("tlvs"), F.when(F.size("anomalies") > 0, F.col("anomalies")).alias("anom"),
    )


def _there(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.parquet(path).limit(1).count() > 0
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def write_pair(packets: DataFrame, batch: int, folder: str) -> bool:
    """L2: one micro-batch into `raw`, then its index, then its mark in `commits`; False if the mark is there already.

    Raw packets come first, as they can't be had again, and the index is made from what was written. A batch that broke off has no
    mark: written again, it replaces its own folders.
    """
    spark = packets.sparkSession
    if _there(spark, f"{folder}/commits/batch={batch}"):
        return False
    packets.write.mode("overwrite").parquet(f"{folder}/raw/batch={batch}")
    index_rows(spark.read.schema(packets.schema).parquet(f"{folder}/raw/batch={batch}")).write.mode("overwrite").parquet(f"{folder}/index/batch={batch}")
    spark.range(1).select(F.lit(batch).alias("n")).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")
    return True


def dual_sink(packets: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """L2: runs a packet stream into raw packets and index rows, both or neither of each micro-batch; gives both tables."""
    _run(packets, folder, "append", lambda w: w.foreachBatch(lambda df, batch: write_pair(df, batch, folder)))
    return committed(packets.sparkSession, folder, "raw"), committed(packets.sparkSession, folder, "index")


def committed(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """Rows of the batches that were written wholly."""
    marks = spark.read.parquet(f"{folder}/commits").select("batch")
    return spark.read.parquet(f"{folder}/{part}").join(F.broadcast(marks), "batch", "left_semi").drop("batch")  # one row a micro-batch


def counters(frames: DataFrame) -> DataFrame:
    """Running counts of frames, points and lost bytes of each recording, for a complete-mode stream or a batch."""
    return frames.groupBy("recording_id").agg(F.count("*").alias("n_frames"), F.sum("num_points").alias("n_points"), F.sum("skipped_before").alias("bytes_skipped"))


def running_counters(frames: DataFrame, folder: str) -> DataFrame:
    """The counts after each micro-batch of a stream of frames (column `batch`), written as it runs: never hidden, never reset."""
    schema = counters(frames).schema

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/totals/batch={batch}")

    _run(counters(frames), folder, "complete", lambda w: w.foreachBatch(put))
    return frames.sparkSession.read.schema(schema.add("batch", "long")).parquet(f"{folder}/totals")


def latest_counters(totals: DataFrame) -> DataFrame:
    """The counts after the last micro-batch."""
    last = totals.agg(F.max("batch").alias("batch"))
    return totals.join(F.broadcast(last), "batch", "left_semi").drop("batch")  # one row


HEALTH = "recording_id long, at_ms long, health string"


def health(reports: DataFrame, silence: float = 3.0, late: str = "0 seconds") -> DataFrame:
    """How a recording's health turns, from reports (recording_id, ts, n_bytes, failed) in a stream.

    The first report is the start. `no data` comes `silence` seconds after it if no bytes do; `ok` with the first bytes, and
    after a silence; `stopped` when `silence` passes after the last bytes, or at once where the reader reports that it failed.
    Event-time timers in keyed state tell silence when nothing comes: they run out as the other recordings' reports move the
    watermark (`late` behind the newest report) on.
    """
    wait = round(silence * 1000)
    ms = lambda c: F.expr(f"unix_millis({c})")

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, str]] = []
        if group.exists:
            at, seen, status = group.get
        else:
            at, seen, status = None, False, "new"

        def silent(now: int | None) -> None:
            nonlocal status
            if status in ("waiting", "ok") and (now is None or now > at + wait):
                status = "stopped" if seen else "no data"
                out.append((at + wait, status))

        if group.hasTimedOut:
            silent(None)
        else:
            rows = sorted(r for pdf in batches for r in zip(pdf["ms"].tolist(), pdf["n_bytes"].fillna(0).tolist(), pdf["failed"].fillna(False).tolist()))
            for now, n, failed in rows:
                if status == "new":
                    at, status = now, "waiting"
                silent(now)
                if n > 0:
                    if status != "ok":
                        out.append((now, "ok"))
                    at, seen, status = now, True, "ok"
                if failed and status != "stopped":
                    out.append((now, "stopped"))
                    status = "stopped"
        if status in ("waiting", "ok"):
            if at + wait < group.getCurrentWatermarkMs():
                silent(None)
            else:
                group.setTimeoutTimestamp(at + wait + 1)
        group.update((at, seen, status))
        yield pd.DataFrame({"recording_id": pd.Series([key[0]] * len(out), dtype="int64"), "at_ms": pd.Series([m for m, _ in out], dtype="int64"), "health": pd.Series([h for _, h in out], dtype=object)})

    timed = reports.withWatermark("ts", late).select("recording_id", "ts", ms("ts").alias("ms"), "n_bytes", "failed")
    return timed.groupBy("recording_id").applyInPandasWithState(step, HEALTH, "at long, seen boolean, status string", "append", GroupStateTimeout.EventTimeTimeout)
