"""Binary captures and configurations (S): bytes to packets to typed rows, config lines to one row a configuration."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dopplerlake.sources.wire import FIELDS, MAGIC, NOISE, POINTS, PROFILE, SIDE, directory
from dopplerlake.streaming import apps
from dopplerlake.streaming.fold import Fold, run_batch


def read_captures(spark: SparkSession, path: str, pattern: str = "*.dat") -> DataFrame:
    """(path, modificationTime, length, content), one row a file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


PIECE = 1 << 16


def read_pieces(spark: SparkSession, path: str, pattern: str = "*.dat") -> DataFrame:
    """Captures of any size as (path, block, piece, bytes), read by many tasks at once: a file is divided at every magic word,
    real or not, whatever its length, so no file and no recording is one cell. A piece lacks the word before it."""
    rows = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("piece"), F.col("value").cast("binary").alias("bytes"))


def slices(captures: DataFrame, size: int = PIECE) -> DataFrame:
    """Captures that are one cell each (recording_id, content) as pieces (recording_id, seq, bytes) of `size` bytes."""
    n = F.ceil(F.octet_length("content") / size).cast("int")
    cut_ = captures.where(n > 0).select("recording_id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return cut_.select("recording_id", F.col("seq").cast("long").alias("seq"), F.expr(f"substring(content, seq * {size} + 1, {size})").alias("bytes"))


def _with_word(fold: Fold) -> Fold:
    """The same fold over pieces that lack the magic word before them, all but a file's first."""

    def step(state, row):
        (inner, begun), (_, _, data, *rest) = state, row
        inner, out = fold.step(inner, (0, MAGIC * begun + bytes(data or b""), *rest))
        return (inner, True), out

    finish = fold.finish and (lambda s: fold.finish(s[0]))
    return Fold(fold.name, ("block", "piece"), fold.columns, fold.output, "", lambda: (fold.start(), False), step, finish)


def _fold(fold: Fold, pieces: DataFrame) -> DataFrame:
    """Runs a fold over (recording_id, seq, bytes), or over pieces as `read_pieces` gives them with a recording_id."""
    rows = pieces if "ts" in pieces.columns or "ts" not in fold.columns else pieces.withColumn("ts", F.lit(None).cast("double"))
    return run_batch(_with_word(fold) if "piece" in pieces.columns else fold, rows)


def cut(pieces: DataFrame) -> DataFrame:
    """Packets of each capture, its chain carried from piece to piece; a task holds one packet and one piece."""
    return _fold(apps.packets(), pieces).select("recording_id", "frame_idx", "byte_offset", "skipped_before", "packet")


def accounting(pieces: DataFrame) -> DataFrame:
    """A1: one row of byte counts a capture."""
    return _fold(apps.accounts(), pieces)


def word(column: str, at: int) -> Column:
    """Unsigned little-endian 32-bit integer at byte `at`, by built-in functions."""
    byte = lambda k: F.conv(F.hex(F.substring(column, at + k + 1, 1)), 16, 10).cast("long")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def header(packets: DataFrame) -> DataFrame:
    """Header fields as columns, SDK version and platform as text."""
    p = packets.withColumns({name: word("packet", 8 + 4 * i) for i, name in enumerate(FIELDS)})
    part = lambda s: F.shiftright("version", s).bitwiseAND(F.lit(255))
    return p.withColumns({"sdk": F.format_string("%d.%d.%d.%d", part(24), part(16), part(8), part(0)), "device": F.concat(F.lit("xWR"), F.regexp_replace(F.hex("platform"), "^A", ""))})


TLVS = "array<struct<type:int,start:int,length:int>>"


def shred(packets: DataFrame) -> DataFrame:
    """Payload directory of each packet by type, anomalies (unknown types, overruns, lengths that count their own header,
    other counts than the header's, bytes left over) and padding."""

    @F.pandas_udf(f"struct<tlvs:{TLVS},anomalies:array<string>,padding:int>")
    def parts(packet: pd.Series) -> pd.DataFrame:
        rows = [directory(p) for p in packet]
        tlvs = [[{"type": k, "start": at, "length": n} for k, at, n in found] for found, _, _ in rows]
        return pd.DataFrame({"tlvs": tlvs, "anomalies": [odd for _, odd, _ in rows], "padding": [pad for _, _, pad in rows]})

    return packets.withColumn("d", parts("packet")).select(*packets.columns, "d.tlvs", "d.anomalies", "d.padding")


def payload(kind: int) -> Column:
    """Bytes of the first payload of a type, or null."""
    t = F.get(F.filter("tlvs", lambda x: x["type"] == kind), F.lit(0))
    return F.when(t.isNotNull(), F.substring(F.col("packet"), t["start"] + 1, t["length"]))


#: What a payload of each type holds: column, type of its numbers, and numbers of one element (fields, divisor).
CELLS = {
    POINTS: ("points", "<f4", ("x", "y", "z", "v"), None), SIDE: ("side", "<i2", ("snr_db", "noise_db"), 10.0), PROFILE: ("range_profile", "<u2", (), None), NOISE: ("noise_profile", "<u2", (), None),
    4: ("azimuth_iq", "<i2", ("re", "im"), 1.0), 5: ("range_doppler", "<u2", (), None), 8: ("antenna_iq", "<i2", ("re", "im"), 1.0), 1050: ("gesture_features", "<f4", (), None), 1051: ("gesture_probs", "<f4", (), None),
}
#: Payloads of one record each, fields in the order of their bytes.
RECORDS = {
    6: ("stats", "<6I", ("processing_us", "output_us", "margin_us", "chirp_margin_us", "active_load", "idle_load")),
    9: ("temperature", "<iI10h", ("valid", "time_ms", "rx0", "rx1", "rx2", "rx3", "tx0", "tx1", "tx2", "pm", "dig0", "dig1")),
}
ARROW = {"<f4": pa.float32(), "<u2": pa.int32(), "<i2": pa.float64()}


def _cells(raw: list[bytes | None], kind: int) -> pa.Array:
    """Lists of one payload type, made from the bytes of a whole batch at once; a partial element at a payload's end is left out."""
    _, dtype, fields, divisor = CELLS[kind]
    step = np.dtype(dtype).itemsize * max(1, len(fields))
    sizes = [0 if r is None else len(r) // step for r in raw]
    flat = np.frombuffer(b"".join(r[: n * step] for r, n in zip(raw, sizes) if r is not None), dtype)
    to = lambda a: pa.array((a / divisor if divisor else a).astype(ARROW[dtype].to_pandas_dtype()), ARROW[dtype])
    values = pa.StructArray.from_arrays([to(flat[i :: len(fields)]) for i in range(len(fields))], list(fields)) if fields else to(flat)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.array([*(r is None for r in raw), False])), values)


def _records(raw: list[bytes | None], kind: int) -> pa.Array:
    """One struct a payload; null where it is missing or too short."""
    _, form, fields = RECORDS[kind]
    size = struct.calcsize(form)
    rows = [None if r is None or len(r) < size else dict(zip(fields, struct.unpack_from(form, r))) for r in raw]
    return pa.array(rows, pa.struct([(f, pa.int64()) for f in fields]))


def decode(shredded: DataFrame, kinds: tuple[int, ...] = (POINTS, SIDE, PROFILE), sizes: dict[int, int] | None = None) -> DataFrame:
    """Payloads of the given types as one column each, in Arrow batches; `sizes` gives how many elements a configuration
    implies, and other numbers are anomalies, as are records that are too short."""
    sizes = {1050: 10, 1051: 10} | (sizes or {})
    keep = [c for c in shredded.columns if c != "anomalies"]
    names = {k: (CELLS.get(k) or RECORDS[k])[0] for k in kinds}
    fields = [*(shredded.schema[c] for c in keep), shredded.schema["anomalies"]]
    spark_of = {"<f4": T.FloatType(), "<u2": T.IntegerType(), "<i2": T.DoubleType()}
    for k in kinds:
        if k in RECORDS:
            kind = T.StructType([T.StructField(f, T.LongType()) for f in RECORDS[k][2]])
        else:
            one = spark_of[CELLS[k][1]]
            kind = T.ArrayType(T.StructType([T.StructField(f, one) for f in CELLS[k][2]]) if CELLS[k][2] else one)
        fields.append(T.StructField(names[k], kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            notes, made = [list(x or []) for x in b.column("anomalies").to_pylist()], []
            for k in kinds:
                raw = b.column(f"__{k}").to_pylist()
                made.append(_records(raw, k) if k in RECORDS else _cells(raw, k))
                least = struct.calcsize(RECORDS[k][1]) if k in RECORDS else 0
                step = np.dtype(CELLS[k][1]).itemsize * max(1, len(CELLS[k][2])) if k in CELLS else 1
                for note, r in zip(notes, raw):
                    if r is not None and k in RECORDS and len(r) < least:
                        note.append(f"{names[k]}_too_short ({len(r)})")
                    if r is not None and k in sizes and len(r) // step != sizes[k]:
                        note.append(f"{names[k]}_size_mismatch (expected {sizes[k]}, got {len(r) // step})")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(notes, pa.list_(pa.string())), *made], [*keep, "anomalies", *names.values()])

    return shredded.select(*keep, "anomalies", *(payload(k).alias(f"__{k}") for k in kinds)).mapInArrow(run, T.StructType(fields))


def parse_configs(lines: DataFrame) -> DataFrame:
    """Command lines (cfg_id, line_no, line) to one row a configuration with derived bins, resolutions and limits."""
    text = F.trim(F.regexp_replace("line", "%.*$", ""))
    cmd = lines.withColumn("w", F.split(text, r"\s+")).withColumn("name", F.get("w", F.lit(0))).where("name <> ''")
    need = {"profileCfg": 14, "frameCfg": 7, "channelCfg": 3, "chirpCfg": 8, "guiMonitor": 7}
    numbers = F.forall(F.slice("w", 2, 100), lambda x: x.try_cast("double").isNotNull())
    sound = reduce(lambda a, b: a | b, ((F.col("name") == k) & (F.size("w") > n) & numbers for k, n in need.items()))
    cmd = cmd.withColumn("ok", sound)
    given = lambda name, i: F.when(F.col("ok") & (F.col("name") == name), F.get("w", F.lit(i + 1)))
    arg = lambda name, i: F.max_by(given(name, i), F.when(F.col("ok") & (F.col("name") == name), F.col("line_no"))).cast("double")
    # the first chirp in which each transmitter fires; transmitters take slots in that order
    fires = lambda tx: F.min(F.when(given("chirpCfg", 7).cast("int").bitwiseAND(F.lit(1 << tx)) > 0, given("chirpCfg", 0).cast("long") * 3 + tx))
    c = cmd.groupBy("cfg_id").agg(
        arg("profileCfg", 1).alias("start_ghz"), arg("profileCfg", 2).alias("idle_us"), arg("profileCfg", 3).alias("adc_start"), arg("profileCfg", 4).alias("ramp_us"), arg("profileCfg", 7).alias("slope"),
        arg("profileCfg", 9).alias("samples"), arg("profileCfg", 10).alias("ksps"), arg("frameCfg", 0).alias("first_chirp"), arg("frameCfg", 1).alias("last_chirp"), arg("frameCfg", 2).alias("loops"),
        arg("frameCfg", 4).alias("period_ms"), arg("channelCfg", 0).cast("int").alias("rx_mask"), arg("channelCfg", 1).cast("int").alias("tx_mask"), *(fires(tx).alias(f"fires{tx}") for tx in range(3)),
        F.collect_list(F.when(~F.col("name").isin(*need), F.col("name"))).alias("unread"),
        F.array_sort(F.collect_list(F.when(F.col("name").isin(*need) & ~F.col("ok"), F.concat(F.lit("cannot read: "), text)))).alias("warnings"),
    )
    c = c.withColumns({"n_tx": F.bit_count("tx_mask").cast("long"), "range_bins": F.pow(F.lit(2.0), F.ceil(F.log2("samples"))).cast("long"), "n_virtual": (F.bit_count("tx_mask") * F.bit_count("rx_mask")).cast("long")})
    # frequencies as the device holds them: whole steps of a 26-bit synthesiser, cut off towards zero
    unit = F.when(F.col("start_ghz") >= 76, 3.6).otherwise(2.7) / float(1 << 26)
    steps = lambda x: F.signum(x) * F.floor(F.abs(x) / unit)
    c = c.withColumns({"start_actual": steps(F.col("start_ghz")) * unit, "slope_actual": steps(F.col("slope")) * unit})
    c = c.withColumn("centre_ghz", F.col("start_actual") + 0.5 * F.col("slope_actual") * F.col("samples") / F.col("ksps") + F.col("slope_actual") * F.col("adc_start") * 1e-8)
    chirp = (F.col("idle_us") + F.col("ramp_us")) * 1e-6
    light = 3e8
    order = F.array_sort(F.array_compact(F.array("fires0", "fires1", "fires2")))
    c = c.withColumns({
        "range_spacing": light * F.col("ksps") * 1e3 / (2 * F.abs("slope_actual") * 1e12 * F.col("range_bins")), "max_velocity": light / (4 * F.col("centre_ghz") * 1e9 * chirp * F.col("n_tx")),
        "velocity_spacing": light / (2 * F.col("centre_ghz") * 1e9 * chirp * F.col("n_tx") * F.col("loops")), "fps": 1000 / F.col("period_ms"), "unread": F.array_sort("unread"),
        "log_to_linear": F.pow(F.lit(2.0), F.ceil(F.log2("n_virtual"))) / F.col("n_virtual") / 256, "bins_per_db": F.lit(20 * math.log10(2)),
        "slots": F.array(*(F.when(F.col(f"fires{tx}").isNull(), -1).otherwise(F.array_position(order, F.col(f"fires{tx}")).cast("int") - 1) for tx in range(3))),
    })
    # what the fixed-point stages of the range transform take off
    comp = F.lit(32.0) / F.col("range_bins")
    return c.withColumns({"compensation": comp, "compensation_db": 20 * F.log10(comp)}).drop("fires0", "fires1", "fires2")


def expected_tlvs(monitor: DataFrame) -> DataFrame:
    """Payload types that monitor flags ask for: points (2: with side information), profile, noise, heat maps, statistics."""
    c = F.col
    made = F.array(*(F.when(cond, F.lit(k)) for k, cond in ((1, c("objects") > 0), (7, c("objects") == 1), (2, c("profile") == 1), (3, c("noise") == 1), (4, c("azimuth_map") == 1), (5, c("doppler_map") == 1), (6, c("stats") == 1), (9, c("stats") == 1))))
    return monitor.withColumn("expected", F.array_join(F.array_compact(made), ","))


def find_runs(files: DataFrame, fallback: list[str]) -> DataFrame:
    """Run directories from a file list (dir, name, modified_at, length): one .dat and at most one .cfg; ambiguous ones fail."""
    ext = lambda e: F.col("name").endswith(e)
    runs = files.groupBy("dir").agg(F.count_if(ext(".dat")).alias("n_dat"), F.count_if(ext(".cfg")).alias("n_cfg"), F.max(F.when(ext(".dat"), F.col("name"))).alias("dat"), F.max(F.when(ext(".cfg"), F.col("name"))).alias("cfg"))
    checked = F.when(F.col("n_cfg") > 1, F.raise_error(F.concat(F.lit("more than one configuration in "), "dir")).cast("string")).otherwise(F.col("cfg"))
    return runs.where("n_dat = 1").select("dir", "dat", F.coalesce(checked, F.lit(fallback[0])).alias("cfg"), (F.col("n_cfg") == 0).alias("cfg_is_fallback"))


def latest(files: DataFrame) -> DataFrame:
    """The recording changed last (ties: the last by directory and name): a top-1, not a sort."""
    return files.where(F.col("name").endswith(".dat")).orderBy(F.desc("modified_at"), F.desc("dir"), F.desc("name")).limit(1)


def background_runs(runs: DataFrame) -> DataFrame:
    """For each run the first directory beside it whose own name holds `empty` and that has a capture and a configuration of
    its own."""
    parent = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    own_name = F.lower(F.substring_index("dir", "/", -1))
    empty = runs.where(own_name.contains("empty") & ~F.col("cfg_is_fallback")).groupBy(parent("dir").alias("parent")).agg(F.min("dir").alias("background"))
    return runs.withColumn("parent", parent("dir")).join(empty, "parent", "left").where("background is null or dir <> background").select("dir", "background")


def write_sessions(features: DataFrame, label: str, path: str) -> str:
    """raw features of labelled sessions, one folder a label; times count from each session's start."""
    start = F.min("t").over(Window.partitionBy("recording_id"))
    features.withColumn("t", F.col("t") - start).write.partitionBy(label).parquet(path)
    return path


def read_sessions(spark: SparkSession, path: str, schema: T.StructType, label: str, labels: list) -> DataFrame:
    """sessions of some labels; folders of other labels are not read."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("t", T.DoubleType())])).parquet(path).where(F.col(label).isin(labels))


def in_order(parts: list[DataFrame]) -> DataFrame:
    """Rows of several parts with the part's number as explicit order key."""
    tagged = [p.withColumn("part", F.lit(i).cast("long")) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out
