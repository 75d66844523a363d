"""Best-fit packing of documents into token sequences (operator 9).

Method: bound-certified repacking. Pieces are dealt evenly to partitions; each partition packs best-fit decreasing and
computes lower bounds on its bin count from dual-feasible functions. A partition whose bin count equals its bound is
certified: it could do no better alone, and keeps its bins but for the emptiest, which may fill another's gap. Partitions
with a gap between bins and bound give up the bins that are not nearly full. What is given up is exchanged and packed
again, `per_partition` pieces to a task at most. Rounds end when one task held all that was left, when nothing was given
up, or when a round saved no bin, so pieces that no packing can pair (all over half a bin, say) are packed once.

Null text: empty text, one sequence item holding the end id alone. Repeated rows: each is packed. Ties: equal lengths keep
the order in which they reach the task; any order gives as many bins. Very long texts: cut into full pieces, which fill
bins alone. Empty table: no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import tokenizer_path, written

CAPACITY = 2048
ITEMS = 40_000
#: A bin with no more than this share of free places is left alone.
SLACK = 0.005
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long, given_up boolean, bins long, bound long"


def cut(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Tokenizes each text, appends `end_id`, and cuts only what is longer than `capacity`; the first piece is the short one."""
    path, end = path or tokenizer_path(), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, library=True).encode
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, size = 0, n if n <= capacity else (n % capacity or capacity)
                for k in range(-(-n // capacity)):
                    rows.append((doc_id, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, size = at + size, capacity
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins needed at least, by two families of dual-feasible functions over the histogram of lengths."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    many, mass = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(mass[-1]) // capacity)
    a = np.arange(1, capacity // 2 + 1)
    large, middle = many[-1] - many[capacity - a], mass[capacity - a] - mass[a - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 13):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        f = np.where(whole, size * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int((count * f).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item and the free places of each bin; a bit mask over free places finds the tightest bin."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    at_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, room = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = at_room[r].pop()
            if not at_room[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        where[i], offset[i], left = b, capacity - r, r - n
        room[b] = left
        if left:
            at_room[left].append(b)
            mask |= 1 << left
    return where, offset, np.array(room, np.int64)


def given_up(room: np.ndarray, bound: int, capacity: int) -> np.ndarray:
    """Which bins of a partition go into the exchange."""
    up = np.zeros(len(room), bool)
    if len(room) > bound:
        up = room > capacity * SLACK
    elif room.max() > capacity * SLACK:
        up[room.argmax()] = True
    return up


def _pack(base: int, capacity: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        lengths = t.column("length").to_numpy()
        where, offset, room = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        up = given_up(room, bound, capacity) & (not last)
        seq = (np.int64(base) << np.int64(56)) + (np.int64(TaskContext.get().partitionId()) << np.int64(32)) + where
        n = t.num_rows
        for name, a in (("sequence_id", seq), ("offset", offset), ("given_up", up[where]), ("bins", np.full(n, len(room))), ("bound", np.full(n, bound))):
            t = t.append_column(name, pa.array(a))
        yield from t.to_batches(max_chunksize=50_000)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = ITEMS) -> DataFrame:
    """Places items of `length` 1..capacity; returns them with sequence_id and offset, and bins and bound of their partition."""
    items = written(items, "pieces")
    kept, round_, left, before = [], 0, items.count(), None
    while left:
        parts = math.ceil(left / per_partition)
        dealt = items.repartition(parts) if parts > 1 else items.coalesce(1)
        placed = written(dealt.mapInArrow(_pack(round_, capacity, parts == 1), PLACED), "packed")
        up = F.col("given_up")
        first = F.col("offset") == 0  # one row for each bin
        found = placed.agg(F.count_if(first).alias("bins"), F.count_if(first & up).alias("up"), F.count_if(up).alias("left")).first()
        if before is not None and found["bins"] >= before:  # an exchange that saved nothing: no more of them
            kept.append(placed)
            break
        kept.append(placed.where(~up))
        items = placed.where(up).select("doc_id", "piece", "start", "length", "ids_crc32")
        left, before, round_ = found["left"], found["up"], round_ + 1
    out = kept[0] if kept else items.sparkSession.createDataFrame([], PLACED)
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.drop("given_up")


def op9_packing(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All documents as pieces with their sequence and place in it."""
    return pack(cut(docs, path=path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound")
