"""ISO media containers (operator 10): store payloads as samples of a small movie file and read its tables back.

Writing: a payload becomes one track of fixed-size samples (`UNIT` bytes each, so lossless 8-bit samples), every
`KEY_EVERY`-th sample marked as a sync sample, laid out in chunks of `PER_CHUNK` samples behind file type and movie boxes.
Reading: boxes are walked level by level; time-to-sample, sample-to-chunk, size, chunk-offset and sync tables are decoded,
which gives codec, duration and the byte range of every keyframe, those of movie fragments too. Payload bytes are only ever
sliced, never decoded.

Null or empty text: one unit of bytes 255. Broken containers: `probe` raises ValueError with the box that is wrong.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
PAD = b"\xff"
KEY_EVERY = 12
PER_CHUNK = 32
TIMESCALE = 48_000
#: The boxes that only hold other boxes, of the ISO base media file format.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """`data` with bytes 255 up to a positive multiple of `unit`."""
    return data + PAD * (max(unit, -(-len(data) // unit) * unit) - len(data))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def store(payload: bytes, unit: int = UNIT, codec: bytes = b"raw ") -> bytes:
    """A movie file whose only track holds `payload` (a positive multiple of `unit` bytes) as 8-bit samples."""
    n = len(payload) // unit
    chunks = -(-n // PER_CHUNK)
    duration = n * unit
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(codec, struct.pack(">6xHHH4xHHHHI", 1, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    runs = [(1, PER_CHUNK)] if n % PER_CHUNK == 0 else [(1, PER_CHUNK), (chunks, n % PER_CHUNK)] if chunks > 1 else [(1, n)]
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")

    def moov(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.uint64) * np.uint64(PER_CHUNK * unit)
        where = full(b"stco", struct.pack(">I", chunks), places.astype(">u4").tobytes()) if first + len(payload) < 2**32 else full(b"co64", struct.pack(">I", chunks), places.astype(">u8").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, unit)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", struct.pack(">II", unit, n)),
            where,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", struct.pack(">hH", 0, 0)), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12xx", 0, b"soun")), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIIIQhhHH", 0, 0, 1, 0, duration, 0, 0, 0, 0x100, 0), matrix, struct.pack(">II", 0, 0), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIHxxQ", 0, 0, TIMESCALE, duration, 0x10000, 0x100, 0), matrix, struct.pack(">6II", 0, 0, 0, 0, 0, 0, 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    first = len(head) + len(moov(0)) + 8
    return b"".join((head, moov(first), box(b"mdat", payload)))


def walk(data: bytes, start: int = 0, stop: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, stop) of the body of each box, outer boxes first; 64-bit and open-ended sizes included."""
    stop = len(data) if stop is None else stop
    while start < stop:
        if stop - start < 8:
            raise ValueError(f"{path}: {stop - start} bytes are no box")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,), body = struct.unpack_from(">Q", data, body), body + 8
        elif size == 0:
            size = stop - start
        if size < body - start or start + size > stop:
            raise ValueError(f"{(*path, kind)}: size {size} does not fit")
        yield (*path, kind), body, start + size
        if kind in NESTED:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


def _box_start(data: bytes, kind: bytes, body: int) -> int:
    """Where the box begins whose body is at `body`."""
    return body - 8 if data[body - 4 : body] == kind else body - 16


def _run(data: bytes, a: int, defaults: dict, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sizes, durations and sync marks of a fragment's run, and where its samples begin (`at` where it does not say)."""
    flags, n = int.from_bytes(data[a + 1 : a + 4], "big"), struct.unpack_from(">I", data, a + 4)[0]
    place, first = a + 8, None
    if flags & 0x1:
        at, place = defaults["base"] + struct.unpack_from(">i", data, place)[0], place + 4
    if flags & 0x4:
        first, place = struct.unpack_from(">I", data, place)[0], place + 4
    fields = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    table = np.frombuffer(data, ">u4", n * len(fields), place).reshape(n, len(fields)).astype(np.int64)
    column = lambda name: table[:, fields.index(name)] if name in fields else np.full(n, defaults[name], np.int64)
    marks = column("flags").copy()
    if first is not None and n:
        marks[0] = first
    return column("size"), column("duration"), marks & 0x10000 == 0, at


def probe(data: bytes) -> list[dict]:
    """One dict for each track: codec, timescale, duration, sizes and places of all samples, sync samples. Samples of movie
    fragments follow those of the track's own tables."""
    tracks: list[dict] = []
    extends: dict[int, dict] = {}
    moof, into, defaults, after = 0, None, {}, 0
    for path, a, _ in walk(data):
        kind = path[-1]
        word = lambda at: struct.unpack_from(">I", data, at)[0]
        if kind == b"trak":
            tracks.append({"codec": "", "timescale": 1, "duration": 0, "sync": None, "id": None, "more": []})
        elif kind == b"trex":
            extends[word(a + 4)] = dict(zip(("duration", "size", "flags"), struct.unpack_from(">III", data, a + 12)))
        elif kind == b"moof":
            moof = after = _box_start(data, kind, a)
        elif kind == b"tfhd":
            flags, ident, place = int.from_bytes(data[a + 1 : a + 4], "big"), word(a + 4), a + 8
            into = next((t for t in tracks if t["id"] == ident), None)
            if into is None:
                raise ValueError(f"a fragment is of track {ident}, which is not there")
            defaults = {"duration": 0, "size": 0, "flags": 0, "shift": 0, "base": moof if flags & 0x20000 else after} | extends.get(ident, {})
            for bit, name, form in ((0x1, "base", ">Q"), (0x2, "", ">I"), (0x8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I")):
                if flags & bit:
                    defaults[name] = struct.unpack_from(form, data, place)[0]
                    place += struct.calcsize(form)
            after = defaults["base"]
        elif kind == b"trun":
            if into is None:
                raise ValueError("a fragment's run has no header")
            sizes, durations, sync, at = _run(data, a, defaults, after)
            ends = at + np.cumsum(sizes)
            after = int(ends[-1]) if len(ends) else at
            into["more"].append((sizes, ends - sizes, sync, int(durations.sum())))
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"tkhd":
            t["id"] = word(a + 20) if data[a] else word(a + 12)
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
        elif kind == b"stsd":
            t["codec"] = data[a + 12 : a + 16].decode("latin-1")
        elif kind == b"stts":
            t["times"] = np.frombuffer(data, ">u4", 2 * word(a + 4), a + 8).reshape(-1, 2).astype(np.int64)
        elif kind == b"stss":
            t["sync"] = np.frombuffer(data, ">u4", word(a + 4), a + 8).astype(np.int64)
        elif kind == b"stsc":
            t["runs"] = np.frombuffer(data, ">u4", 3 * word(a + 4), a + 8).reshape(-1, 3).astype(np.int64)
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, a + 4)
            t["sizes"] = np.full(n, same, np.int64) if same else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = np.frombuffer(data, ">u4" if kind == b"stco" else ">u8", word(a + 4), a + 8).astype(np.int64)
    for t in tracks:
        missing = {"sizes", "runs", "chunks", "times"} - t.keys()
        if missing:
            raise ValueError(f"a track lacks {sorted(missing)}")
        first = np.append(t["runs"][:, 0], len(t["chunks"]) + 1)
        per = np.repeat(t["runs"][:, 1], np.diff(first))
        in_chunk = np.repeat(np.arange(len(per)), per)[: len(t["sizes"])]
        before = np.cumsum(t["sizes"]) - t["sizes"]
        starts = np.concatenate([[0], np.cumsum(per)[:-1]])
        t["places"] = t["chunks"][in_chunk] + before - before[starts[in_chunk]]
        sync = np.arange(len(t["sizes"])) if t["sync"] is None else t["sync"] - 1
        for sizes, places, marks, duration in t.pop("more"):
            sync = np.concatenate([sync, len(t["sizes"]) + np.flatnonzero(marks)])
            t["sizes"], t["places"] = np.concatenate([t["sizes"], sizes]), np.concatenate([t["places"], places])
            t["duration"] += duration
        t["keyframes"] = np.stack([t["places"][sync], t["places"][sync] + t["sizes"][sync]], axis=1)
        if len(t["sizes"]) and (t["places"] + t["sizes"]).max() > len(data):
            raise ValueError("samples lie beyond the end of the file")
    return tracks


def read_back(data: bytes) -> tuple[bytes, list[dict]]:
    """The first track's sample bytes in order, by its tables, and all tracks. Touching samples are sliced as one run."""
    tracks = probe(data)
    if not tracks or not len(tracks[0]["sizes"]):
        raise ValueError("there is no track with samples")
    t = tracks[0]
    ends = t["places"] + t["sizes"]
    cuts = np.flatnonzero(t["places"][1:] != ends[:-1]) + 1
    lo, hi = np.concatenate([[0], cuts]), np.append(cuts, len(ends)) - 1
    return b"".join(data[a:b] for a, b in zip(t["places"][lo].tolist(), ends[hi].tolist())), tracks


def feature(tracks: list[dict]) -> str:
    """Codec, duration, samples and keyframe byte ranges (count, first, last and a checksum over all) of the first track."""
    if not tracks or not len(tracks[0]["keyframes"]):
        raise ValueError("there is no track with keyframes")
    t = tracks[0]
    k = t["keyframes"]
    seconds = t["duration"] / t["timescale"]
    return f"codec={t['codec'].strip()};seconds={seconds:.6f};samples={len(t['sizes'])};keyframes={len(k)};first={k[0][0]}-{k[0][1]};last={k[-1][0]}-{k[-1][1]};ranges={zlib.crc32(k.astype('<i8').tobytes()):08x}"


def encode_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Column `media` (binary): each text's container. Other columns are kept, `text` goes."""
    rest = [c for c in df.columns if c != text and c != "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [store(padded((v or "").encode())) for v in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(made, pa.binary())], [*rest, "media"])

    from pyspark.sql import types as T

    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("media", T.BinaryType())])
    return df.select(*(F.col(f"`{c}`") for c in [*rest, text])).mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, keyframes array<struct<start:long,stop:long>>"


def describe_media(df: DataFrame) -> DataFrame:
    """Reads `media` back (with `doc_id` and `n_bytes`): payload digests, codec, duration and all keyframe byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "keyframes"]
        for b in batches:
            rows = []
            for doc_id, n, m in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist()):
                payload, tracks = read_back(m)
                t = tracks[0]
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(tracks), t["codec"].strip(), t["duration"] / t["timescale"], [{"start": x, "stop": y} for x, y in t["keyframes"].tolist()]))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)


def op10_media(docs: DataFrame) -> DataFrame:
    """Stores every text as a container and reads it back: digests and feature string of each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return describe_media(encode_media(rows)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
