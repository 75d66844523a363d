"""Captures made from the given tables: packets of points and of dense payloads, laid end to end in pieces with losses."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dopplerlake.sources.fixtures import table
from dopplerlake.sources.wire import HEADER, MAGIC, PAD, POINTS, SIDE


def pack(frame: int, objects: int, payloads: list[tuple[int, bytes]]) -> bytes:
    """One packet with the given payloads, padded to 32 bytes."""
    body = b"".join(struct.pack("<II", kind, len(data)) + data for kind, data in payloads)
    n = -(-(HEADER + len(body)) // PAD) * PAD
    return (MAGIC + struct.pack("<8I", 0x03060000, n, 0xA6843, frame, frame * 8_000_000 % 2**32, objects, len(payloads), 0) + body).ljust(n, b"\x0f")


def encode_dense(frames: DataFrame) -> DataFrame:
    """Packets (recording_id, frame_idx, packet) of all payload types but points, from frames of 64 `values`."""

    @F.pandas_udf("binary")
    def build(frame: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for f, v in zip(frame, values):
            v = np.asarray(v, float)
            size, turned, real = np.floor(np.abs(v) * 1000).astype("<u2").tobytes(), np.floor(np.abs(v[::-1]) * 1000).astype("<u2").tobytes(), np.floor(v * 1000).astype("<i2").tobytes()
            out.append(pack(f, 0, [
                (2, size), (3, turned), (4, real), (5, size), (6, struct.pack("<6I", f, 2, f * 3, 4, f % 100, 6)), (8, real), (9, struct.pack("<iI10h", 0, f * 40, *(20 + f % 7 - k for k in range(10)))),
                (1050, (v[:10] * 10).astype("<f4").tobytes()), (1051, v[10:20].astype("<f4").tobytes()),
            ]))
        return pd.Series(out)

    return frames.select("recording_id", "frame_idx", build("frame_idx", "values").alias("packet"))


def encode(frames: DataFrame) -> DataFrame:
    """The inverse: `packet` from frame arrays (recording_id, frame_idx, points, side), padded to 32 bytes."""

    @F.pandas_udf("binary")
    def build(frame: pd.Series, xyzv: pd.Series, side: pd.Series) -> pd.Series:
        out = []
        for f, p, s in zip(frame, xyzv, side):
            out.append(pack(f, len(p) // 4, [(POINTS, np.asarray(p, "<f4").tobytes()), (SIDE, np.asarray(s, "<i2").tobytes())]))
        return pd.Series(out)

    flat = F.flatten(F.transform("points", lambda q: F.array(q["x"], q["y"], q["z"], q["v"])))
    tenths = F.flatten(F.transform("side", lambda q: F.array(F.rint(F.coalesce(q["snr_db"], F.lit(0.0)) * 10), F.rint(F.coalesce(q["noise_db"], F.lit(0.0)) * 10))))
    return frames.select("recording_id", "frame_idx", build("frame_idx", flat, tenths).alias("packet"))


def as_pieces(packets: DataFrame, size: int = 1 << 16, head: bytes = b"", tail: bytes = b"") -> DataFrame:
    """Packets of a recording end to end, with a few foreign bytes before every tenth, cut into pieces of `size` bytes without
    regard to packets (recording_id, seq, bytes): what a lossy recording looks like. `head` and `tail` go around it.

    No recording is gathered: each packet is divided at the piece borders it lies over, and only a piece is put together.
    """
    noisy = F.when(F.col("frame_idx") % 10 == 3, F.concat(F.lit(bytes(5)), "packet")).otherwise(F.col("packet"))
    w = Window.partitionBy("recording_id").orderBy("frame_idx")
    rows = packets.select("recording_id", "frame_idx", noisy.alias("b"))
    if head or tail:
        last = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("frame_idx"))) == 1
        first = F.row_number().over(w) == 1
        rows = rows.withColumns({"first": first, "last": last}).select("recording_id", "frame_idx", F.concat(F.when(F.col("first"), F.lit(head)).otherwise(F.lit(b"")), "b", F.when(F.col("last"), F.lit(tail)).otherwise(F.lit(b""))).alias("b"))
    n = F.octet_length("b")
    rows = rows.withColumn("at", F.sum(n).over(w) - n)
    seq = F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + n - 1) / size)))
    parts = rows.withColumn("seq", seq).withColumn("low", F.greatest(F.col("seq") * size - F.col("at"), F.lit(0)))
    parts = parts.select("recording_id", "seq", "at", F.hex(F.expr(f"substring(b, cast(low + 1 as int), cast(least((seq + 1) * {size} - at, octet_length(b)) - low as int))")).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
    return parts.groupBy("recording_id", "seq").agg(F.unhex(joined).alias("bytes"))


def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five command lines a configuration, from the part table."""
    k = F.col("p_partkey")
    text = lambda *x: F.concat_ws(" ", *(y if not isinstance(y, str) else F.lit(y) for y in x))
    num = lambda x: x.cast("string")
    lines = F.array(
        F.lit("% made from a table"), text("channelCfg", "15", num(k % 7 + 1), "0"), text("profileCfg", "0", num(k % 4 + 60), num(k % 50 + 7), "3", num(k % 30 + 24), "0", "0", F.concat(num(k % 60 + 20), F.lit(".013")), "1", num(k % 200 + 65), num(k % 5000 + 2000), "0", "0", "30"),
        text("chirpCfg", "0", "0", "0", "0", "0", "0", "0", "1"), text("chirpCfg", "1", "1", "0", "0", "0", "0", "0", F.when(k % 2 == 0, "4").otherwise("2")), F.when(k % 3 == 0, "chirpCfg 2 2 0 0 0 0 0 6").otherwise("chirpCfg 2 two"),
        text("frameCfg", "0", "2", num(k % 64 + 16), "0", num(k % 90 + 10), "1", "0", "% trigger"), text("calibDcRangeSig", "-1", "0"),
    )
    return table(spark, sf_dir, "part").select(k.alias("cfg_id"), F.posexplode(lines).alias("line_no", "line"))
