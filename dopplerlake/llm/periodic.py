"""Periodic run detection in word sequences (operator 12): repetitions of exponent 3 or more, by string synchronising sets.

At each dyadic scale t (4, 8, 16, ...) a position is selected by the hashes of the t-word fragments after it: i is in the set if
the least hash among fragments i to i + t stands at i or at i + t, where fragments of period t / 3 or less do not count. So
the choice depends on the 2t words from i alone, every run of period p in [2t - 1, 4t - 2] and length 3p or more holds a
chosen i with i + p also chosen and equal 2t words after both, and in any window chosen positions with equal contexts are
more than t / 3 apart. Pairs of chosen positions with equal context hashes at such a distance propose a period; a proposal is
extended word by word, so hashes propose and never decide. The highly periodic fragments, left out of the sets, belong to runs
of small period: periods up to SMALL are found by comparing the sequence with itself shifted, larger ones at the scales before.

Many texts are one sequence: words are numbered for a portion of texts of like length, and a number that occurs once stands
between two texts, over which no run can reach. A task holds the words of one portion (`PORTION` words, or one longer text).

Null text: no words, no runs, empty text left. Fewer words than LEAST: no runs. Repeated rows, null and repeated ids: a row each.
Empty table: no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

LEAST = 24
SMALL = 6
PORTION = 400_000
MOST = np.uint64(2**64 - 1)
RUN = "struct<start:long,length:long,period:long>"
FOUND = f"doc_id long, n_words long, best {RUN}, runs array<{RUN}>, collapsed string"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring fragments, of their hashes in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours: blocks of that width, from the left and from the right."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, MOST, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def synchronising(h: np.ndarray, t: int, periodic: list[tuple[int, int]]) -> np.ndarray:
    """Chosen positions for fragments of t words with hashes `h`; `periodic` are stretches (start, stop) of period t / 3 or less."""
    phi = h >> np.uint64(1)
    for start, stop in periodic:
        phi[start : stop - t + 1] = MOST
    least = _window_least(phi, t + 1)
    n = len(least)
    return np.flatnonzero((least < MOST) & ((least == phi[:n]) | (least == phi[t : t + n])))


def proposals(chosen: np.ndarray, context: np.ndarray, low: int, high: int) -> np.ndarray:
    """Rows (period, position), sorted: chosen positions with equal contexts, `low` to `high` apart."""
    key = context[chosen]
    order = np.argsort(key, kind="stable")
    key, at, out, k = key[order], chosen[order], [], 1
    while k < len(at):
        apart = at[k:] - at[:-k]
        near = (key[k:] == key[:-k]) & (apart <= high)
        if not near.any():
            break
        hit = np.flatnonzero(near & (apart >= low))
        out.append(np.stack([apart[hit], at[:-k][hit]], 1))
        k += 1
    rows = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _stretch(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The largest [start, stop) around i in which every word equals that p places on (empty if i does not)."""
    stop, end, step = i, len(w) - p, 64
    while stop < end:
        differs = w[stop : min(stop + step, end)] != w[stop + p : min(stop + step, end) + p]
        if differs.any():
            stop += int(differs.argmax())
            break
        stop, step = min(stop + step, end), 2 * step
    if stop == i:
        return i, i
    start, step = i, 64
    while start > 0:
        from_ = max(0, start - step)
        differs = (w[from_:start] != w[from_ + p : start + p])[::-1]
        if differs.any():
            start -= int(differs.argmax())
            break
        start, step = from_, 2 * step
    return start, stop


def runs_of(w: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All (start, stop, period) of length 3 periods or more in a sequence of numbers; no run is longer than `longest`."""
    n = len(w)
    longest = n if longest is None else longest
    found: dict[tuple[int, int], int] = {}  # smallest periods come first, and larger ones of the same stretch are their multiples
    for q in range(1, min(SMALL, longest // 3) + 1):
        same = np.concatenate(([0], (w[q:] == w[:-q]).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(same))
        start, stop = edges[::2], edges[1::2]
        keep = stop - start >= 2 * q
        for a, b in zip(start[keep].tolist(), stop[keep].tolist()):
            found.setdefault((a, b + q), q)
    t, h = 1, _mixed(w.astype(np.uint64), np.zeros(n, np.uint64))
    while 2 * t - 1 <= SMALL:
        h, t = _mixed(h[:-t], h[t:]) if len(h) > t else h[:0], 2 * t
    while 3 * (2 * t - 1) <= longest:
        context = _mixed(h[:-t], h[t:])
        chosen = synchronising(h, t, [(s, e) for (s, e), q in found.items() if 3 * q <= t <= e - s])
        last, until = 0, 0
        for p, i in proposals(chosen, context, 2 * t - 1, 4 * t - 2).tolist():
            if p == last and i < until:
                continue
            start, stop = _stretch(w, i, p)
            last, until = p, stop
            if stop - start >= 2 * p:
                found.setdefault((start, stop + p), p)
        h, t = context, 2 * t
    return [(s, e, q) for (s, e), q in found.items()]


def _classes(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows by like numbers of words, as many as PORTION words hold; rows too short for any run are left out."""
    kinds = np.frexp(lengths)[1]
    for kind in np.unique(kinds[lengths >= LEAST]):
        rows = np.flatnonzero((kinds == kind) & (lengths >= LEAST))
        portion = np.cumsum(lengths[rows]) // PORTION
        yield from np.split(rows, np.flatnonzero(np.diff(portion)) + 1)


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of LEAST words and 3 periods or more in each list of words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for rows in _classes(np.array([len(x) for x in texts], np.int64)):
        number: dict[bytes, int] = {}
        for r in rows:
            for x in texts[r]:
                number.setdefault(x, len(number))
        sizes = np.array([len(texts[r]) for r in rows])
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        w = np.empty(begin[-1], np.int64)
        for k, r in enumerate(rows):
            w[begin[k] : begin[k + 1] - 1] = np.fromiter(map(number.__getitem__, texts[r]), np.int64, len(texts[r]))
            w[begin[k + 1] - 1] = len(number) + k
        for s, e, q in runs_of(w, int(sizes.max())):
            if e - s >= max(LEAST, 3 * q):
                k = int(np.searchsorted(begin, s, "right")) - 1
                out[rows[k]].append((s - int(begin[k]), e - s, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those that a run contains after its first period."""
    stay = np.ones(n, bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


def _records(rows: list[tuple[int, int, int] | None]) -> pa.StructArray:
    parts = list(zip(*(r or (None,) * 3 for r in rows))) or [()] * 3
    fields = [pa.array(p, pa.int64()) for p in parts]
    return pa.StructArray.from_arrays(fields, ["start", "length", "period"], mask=pa.array([r is None for r in rows], pa.bool_()))


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """Each document's periodic runs and the text without their repetitions (words joined by one space).

    `rewrite(doc_id, n)` may name (a, p) for a text of n words: each word i >= a is then word a + (i - a) % p of the original.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = batch.column("doc_id").to_pylist(), utf8(batch.column("text"))
            at = 0
            while at < len(ids):
                # a portion of texts, by bytes (a word takes six or so with its space)
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 6 * PORTION, "right")) - 1)
                texts = [data[a:b].tobytes().split() for a, b in zip(offsets[at:stop], offsets[at + 1 : stop + 1])]
                for k, doc_id in enumerate(ids[at:stop]):
                    change = rewrite(doc_id, len(texts[k])) if rewrite else None
                    if change:
                        a, p = change
                        x = texts[k]
                        texts[k] = [x[a + (i - a) % p] if i >= a else x[i] for i in range(len(x))]
                runs = runs_of_texts(texts)
                left = [b" ".join(x if not r else [x[i] for i in np.flatnonzero(kept_words(len(x), r))]) for x, r in zip(texts, runs)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), _records([r for rs in runs for r in rs]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at:stop], pa.int64()), pa.array(list(map(len, texts)), pa.int64()), _records(list(map(best_of, runs))), lists, pa.array(left, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "best", "runs", "collapsed"],
                )
                at = stop

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The contract's change of every tenth text by crc32 of its id (a null id counts as empty text)."""
    import zlib

    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or n == 0:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op12_periodic(docs: DataFrame) -> DataFrame:
    """Runs of every text: their number, the one of greatest exponent, and digests of all runs and of the text that is left."""
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return periodic_runs(docs, planted).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
