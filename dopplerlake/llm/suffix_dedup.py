"""Exact-substring dedup with a logarithmic family of suffix-array indexes (operator 4).

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Texts are bundled by doc_id or row number; what is
kept of a bundle is decided from its bytes and from sets of hashes that concern it, so rows need no identity.

1. Sampled suffixes. Of the `length - k + 1` windows of k bytes inside each string of `length` bytes, the one with the
   smallest hash is its anchor (a minimizer): equal strings have equal anchors at equal places. An anchor's suffix entry is
   (hash of its k bytes, hash of all bytes that a string through it can reach, bundle). About one position in 30 is kept.
2. Index family. Entries are dealt to shards by the k-byte hash; in each shard, batches of bundles arrive one after the
   other. A batch gets its suffix array (entries in suffix order: by leading k bytes, then by reach, each through its
   hash), is merge-scanned against every existing level for long matches, and becomes a level itself; two levels of equal
   size merge into one of the next, as in the logarithmic method. So a new batch costs a scan of log(n) sorted levels.
   The outcome per entry: nothing matches; the whole reach is repeated; or the suffix matches and the reach does not.
3. Edges. Only for the last kind, hashes of the single strings around the anchor meet once more and are counted.
4. Each bundle marks its repeated strings, and takes out the bytes under them.

A hash of a k-byte start that is frequent within a bundle is told to its shard once, and its entries go to shards by their
reach, so no shard holds a passage that fills the corpus. Equality is of 64-bit polynomial hashes over random byte values
(finished by a mixer): a false match has a chance near 1e-5 at 10^7 entries.

The same holds over words: a rule with `words` takes each text as the hashes of its words (between ASCII white space), so
its length and k count words, and what goes reaches from the first byte of the first word to the last of the last. Several
rules are all decided on the whole texts, and a byte goes if any of them says so.

Null or empty text: nothing to remove, digest of no bytes. Texts shorter than `length` keep everything. Repeated rows:
each counts as another place. Null or repeated doc_id: all rows are bundled by a row number that is written with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces_of, utf8, written

LENGTH = 400
ANCHOR = 340


class Rule(NamedTuple):
    """Strings of how many bytes or words count as repeated, and the bytes or words of an anchor."""

    length: int
    k: int
    words: bool = False


BYTES = Rule(LENGTH, ANCHOR)
#: Passages of over 50 words.
PASSAGES = Rule(51, 36, words=True)
#: Kinds of the rules lie this far apart.
APART = 8
BUNDLE = 256
BATCHES = 8
CROWD = 16
PIECE = 1 << 19
#: Bytes of text whose entries are gathered before they are counted and sent.
PORTION = 1 << 23
FULL, EDGE, TELL = 1, 2, 3
U = np.uint64
TOP = U(2**64 - 1)
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(400).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def sliding(a: np.ndarray, width: int, op: np.ufunc, pad) -> np.ndarray:
    """op over a[i : i + width] for each i, by running values of blocks from either side."""
    n = len(a)
    b = np.full(-(-(n + width) // width) * width, pad, a.dtype)
    b[:n] = a
    b = b.reshape(-1, width)
    ahead = op.accumulate(b, axis=1).ravel()
    behind = op.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : n + width - 1])


def units(raw: np.ndarray, offsets: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """What a rule counts in some texts laid end to end: symbols, their offsets, and for words their first and last + 1 bytes."""
    if not rule.words:
        return raw, offsets, None, None
    n = len(raw)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before, after = np.concatenate([[True], white[:-1]])[:n], np.concatenate([white[1:], [True]])[:n]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    begins, stops = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    power, inverse = _powers(max(1 << max(12, int(n + 1).bit_length()), 1 << 20))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_letters()[raw] * power[:n], out=sums[1:])
    return mix((sums[stops] - sums[begins]) * inverse[begins]) | U(1), np.searchsorted(begins, offsets), begins, stops


class Scan:
    """Anchors of some texts laid end to end, and hashes of any of their strings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, core: tuple[int, int] | None = None, length: int = LENGTH, k: int = ANCHOR):
        """`core`: the range whose anchors count; bytes around it are only context."""
        self.length, self.k, n = length, k, len(data)
        lengths = np.diff(offsets)
        size = 1 << max(12, int(n + 1).bit_length())
        self.power, self.inverse = _powers(max(size, 1 << 20))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_letters()[data] if data.dtype == np.uint8 else data) * self.power[:n], out=self.sums[1:])
        end = np.repeat(offsets[1:], lengths)
        self.begin_of, self.end_of = np.repeat(offsets[:-1], lengths), end
        place = np.arange(n)
        self.grams = np.full(n, TOP)
        m = max(0, n - k + 1)
        self.grams[:m] = self.hashes(place[:m], place[:m] + k)
        self.grams[place + k > end] = TOP
        self.starts = place + length <= end
        self.least = sliding(self.grams, length - k + 1, np.minimum, TOP)
        self.least[~self.starts] = 0
        high = sliding(self.least[::-1].copy(), length - k + 1, np.maximum, U(0))[::-1]
        self.anchors = np.flatnonzero((high == self.grams) & (self.grams != TOP) & (high != 0))
        self.core = np.ones(len(self.anchors), bool) if core is None else (self.anchors >= core[0]) & (self.anchors < core[1])
        reach = length - k
        self.low = np.maximum(self.anchors - reach, self.begin_of[self.anchors])
        self.high = np.minimum(self.anchors + length, end[self.anchors])
        self.heads = self.grams[self.anchors]
        self.reach = mix(self.hashes(self.low, self.high) + (self.anchors - self.low).astype(U) * U(0xD6E8FEB86659FD93) + (self.high - self.anchors).astype(U) * U(0xA0761D6478BD642F))

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a])

    def strings_at(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of the strings whose first anchor is one of the chosen anchors (a mask over anchors)."""
        marked = np.zeros(len(self.grams), bool)
        marked[self.anchors[chosen]] = True
        around = np.zeros(len(self.grams) + 1, np.int64)
        np.add.at(around, self.low[chosen], 1)
        np.add.at(around, self.anchors[chosen] + 1, -1)
        near = np.flatnonzero((np.cumsum(around)[:-1] > 0) & self.starts)
        nxt = np.searchsorted(self.anchors, near)
        # the first anchor at or after a start whose hash is the start's minimum
        while True:
            wrong = self.grams[self.anchors[nxt]] != self.least[near]
            if not wrong.any():
                break
            nxt = nxt + wrong
        return near[marked[self.anchors[nxt]]]


def windows_of(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE, rule: Rule = BYTES) -> Iterator[tuple[int, Scan]]:
    """(start, scan) over texts laid end to end: as they are up to `limit` bytes, else cut with enough bytes around each
    core that its anchors, reaches and strings are those of the whole text."""
    size, around = int(offsets[-1]), 2 * rule.length
    if size < rule.length:
        return
    if size <= 2 * limit:
        yield 0, Scan(data, offsets, None, rule.length, rule.k)
        return
    for c in range(0, size, limit):
        a, b = max(0, c - around), min(size, c + limit + around)
        yield a, Scan(data[a:b], np.unique(np.clip(offsets - a, 0, b - a)), (c - a, min(c + limit, size) - a), rule.length, rule.k)


def _scans(batch, rule: Rule) -> Iterator[Scan]:
    data, offsets = utf8(batch.column("text"))
    for i, j in pieces_of(offsets, PIECE):
        symbols, own, _, _ = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule)
        for _, s in windows_of(symbols, own, PIECE, rule):
            yield s


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in columns.values()], list(columns))


ENTRY = "shard_key long, reach long, bundle long, places int, mixed boolean"


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i, j in pieces_of(utf8(batch.column("text"))[1], PORTION):
        yield batch.slice(i, j - i)


def _entries(batches: Iterator[pa.RecordBatch], rule: Rule = BYTES) -> Iterator[pa.RecordBatch]:
    """Suffix entries of each bundle, equal ones counted (up to 2); starts that crowd a bundle are told once."""
    for b in (part for whole in batches for part in _portions(whole)):
        bundles = b.column("bundle").to_numpy(zero_copy_only=False)
        data, offsets = utf8(b.column("text"))
        heads, reaches, owners = [], [], []
        for i, j in pieces_of(offsets, PIECE):
            symbols, own, _, _ = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule)
            for a, s in windows_of(symbols, own, PIECE, rule):
                row = np.searchsorted(own, s.anchors[s.core] + a, "right") - 1 + i
                heads.append(s.heads[s.core])
                reaches.append(s.reach[s.core])
                owners.append(bundles[row])
        if not any(map(len, heads)):
            continue
        h, r, o = np.concatenate(heads), np.concatenate(reaches), np.concatenate(owners).astype(np.int64)
        order = np.lexsort((r, h, o))
        h, r, o = h[order], r[order], o[order]
        new_h = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
        new = new_h | np.concatenate([[True], r[1:] != r[:-1]])
        at = np.flatnonzero(new)
        places = np.minimum(np.diff(np.append(at, len(h))), 2).astype(np.int32)
        h, r, o, new_h = h[at], r[at], o[at], new_h[at]
        run = np.cumsum(new_h) - 1
        crowd = np.bincount(run)[run] >= CROWD
        told = crowd & new_h
        key = np.where(crowd, mix(r), h)
        k = int(told.sum())
        yield _table(
            shard_key=np.concatenate([key, h[told]]), reach=np.concatenate([r, np.zeros(k, np.uint64)]), bundle=np.concatenate([o, o[told]]),
            places=np.concatenate([places, np.full(k, 2, np.int32)]), mixed=np.concatenate([crowd, np.ones(k, bool)]),
        )


class Level:
    """One suffix array of the family: entries sorted by start, then reach; equal ones of a bundle are one entry."""

    def __init__(self, key, reach, bundle, places, mixed):
        order = np.lexsort((bundle, reach, key))
        self.columns = [c[order] for c in (key, reach, bundle, places, mixed)]

    def __len__(self) -> int:
        return len(self.columns[0])

    def merged(self, other: Level) -> Level:
        return Level(*(np.concatenate(c) for c in zip(self.columns, other.columns)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Merge-scan: which of the sorted keys start an entry of this level."""
        at = np.searchsorted(self.columns[0], keys)
        return self.columns[0][np.minimum(at, len(self) - 1)] == keys


class Family:
    """Levels of doubling size; a batch is scanned against all of them before it joins."""

    def __init__(self):
        self.levels: list[tuple[int, Level]] = []
        self.hits: list[np.ndarray] = []

    def add(self, batch: Level) -> None:
        keys = batch.columns[0]
        many = np.concatenate([[False], keys[1:] == keys[:-1]]) | (batch.columns[3] > 1) | batch.columns[4]
        self.hits.append(np.unique(keys[many]))
        once = np.unique(keys)
        for _, level in self.levels:
            self.hits.append(once[level.find(once)])
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            batch = self.levels.pop()[1].merged(batch)
            rank += 1
        self.levels.append((rank, batch))

    def matched(self) -> tuple[np.ndarray, ...]:
        """Entries of all levels whose start matched, in suffix order."""
        hits = np.unique(np.concatenate(self.hits))
        parts = [[c[np.isin(level.columns[0], hits)] for c in level.columns] for _, level in self.levels]
        return tuple(Level(*(np.concatenate(c) for c in zip(*parts))).columns)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs one shard's batches through a family; gives (bundle, kind, key) for all entries that matched."""
    tables = list(batches)
    if not tables or not sum(b.num_rows for b in tables):
        return
    t = pa.Table.from_batches(tables)
    key, reach, bundle, places = (t.column(c).to_numpy() for c in ("shard_key", "reach", "bundle", "places"))
    mixed = t.column("mixed").to_numpy(zero_copy_only=False)
    key, reach = key.view(np.uint64), reach.view(np.uint64)
    lot = bundle % BATCHES
    family = Family()
    for i in range(BATCHES):
        m = lot == i
        if m.any():
            family.add(Level(key[m], reach[m], bundle[m], places[m], mixed[m]))
    key, reach, bundle, places, mixed = family.matched()
    if not len(key):
        return
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], reach[1:] != reach[:-1]])
    g, k = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    full = np.bincount(g, places) >= 2
    several = (np.bincount(k[new]) > 1) | (np.bincount(k, mixed) > 0)
    kind = np.where(full[g], np.where(several[k] & new, TELL, FULL), EDGE).astype(np.int32)
    told = reach != 0
    yield _table(bundle=bundle[told], kind=kind[told], key=reach[told])


def _chosen(hits: pa.Table, kind: int) -> np.ndarray:
    kinds = hits.column("kind").to_numpy()
    return np.unique(hits.column("key").to_numpy()[kinds == kind].view(np.uint64))


def _strings(texts: pa.Table, hits: pa.Table, rule: Rule) -> pa.Table:
    """Hashes of the single strings around edges (and those that are known to repeat), counted within the bundle."""
    edge, tell = _chosen(hits, EDGE), _chosen(hits, TELL)
    found, weight, asked = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    if len(edge) or len(tell):
        for s in _scans(texts, rule):
            for keys, w in ((edge, 1), (tell, 2)):
                at = s.strings_at(np.isin(s.reach, keys) & s.core) if len(keys) else np.zeros(0, np.int64)
                if len(at):
                    found.append(s.hashes(at, at + rule.length))
                    weight.append(np.full(len(at), w))
                    asked.append(np.full(len(at), w == 1))
    h, back = np.unique(np.concatenate(found), return_inverse=True)
    n = np.minimum(np.bincount(back, np.concatenate(weight), len(h)), 2).astype(np.int32) if len(h) else np.zeros(0, np.int32)
    q = np.bincount(back, np.concatenate(asked), len(h)) > 0 if len(h) else np.zeros(0, bool)
    bundle = hits.column("bundle")[0].as_py() if hits.num_rows else 0
    return pa.Table.from_batches([_table(key=h, bundle=np.full(len(h), bundle, np.int64), places=n, asked=q)])


def _gone(raw: np.ndarray, offsets: np.ndarray, rule: Rule, full: np.ndarray, single: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Which bytes of some texts laid end to end a rule takes out."""
    if not len(full) and not len(single):
        return np.zeros(len(raw), bool)
    symbols, own, begins, stops = units(raw, offsets, rule)
    delta = np.zeros(len(symbols) + 1, np.int32)
    for a, s in windows_of(symbols, own, PIECE, rule):
        m = np.isin(s.reach, full) & s.core
        np.add.at(delta, s.low[m] + a, 1)
        np.add.at(delta, s.high[m] + a, -1)
        if len(single):
            at = s.strings_at(np.isin(s.reach, edge) & s.core)
            at = at[np.isin(s.hashes(at, at + rule.length), single)] + a
            np.add.at(delta, at, 1)
            np.add.at(delta, at + rule.length, -1)
    gone = np.cumsum(delta)[:-1] > 0
    if not rule.words:
        return gone
    first = np.zeros(len(symbols) + 1, bool)
    first[own] = True
    joined = gone[1:] & gone[:-1] & ~first[1:-1]  # the white space between two words of a text that both go
    covered = np.zeros(len(raw) + 1, np.int32)
    np.add.at(covered, begins[gone], 1)
    np.add.at(covered, np.where(np.append(joined, False), np.append(begins[1:], len(raw)), stops)[gone] if len(gone) else stops, -1)
    return np.cumsum(covered)[:-1] > 0


def _kept(texts: pa.Table, hits: pa.Table, rules: tuple[Rule, ...], watched: tuple[Rule, ...] = ()) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(row, remaining bytes, removed bytes, removed runs, bytes under `watched` rules) of each text of a bundle."""
    none = np.zeros(0, np.uint64)
    sets = []
    for n in range(len(rules) + len(watched)):
        full, tell, single, edge = (_chosen(hits, kind + APART * n) if hits.num_rows else none for kind in (FULL, TELL, 0, EDGE))
        sets.append((np.union1d(full, tell), single, edge))
    data, offsets = utf8(texts.column("text"))
    for i, j in pieces_of(offsets, PIECE):
        raw, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        gone, seen = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        for n, (rule, chosen) in enumerate(zip((*rules, *watched), sets)):
            if n < len(rules):
                gone |= _gone(raw, ends, rule, *chosen)
            else:
                seen |= _gone(raw, ends, rule, *chosen)
        for r in range(i, j):
            a, b = ends[r - i], ends[r - i + 1]
            g, w = gone[a:b], int(np.count_nonzero(seen[a:b]))
            if not g.any():
                yield r, raw[a:b].tobytes(), 0, 0, w
            else:
                yield r, raw[a:b][~g].tobytes(), int(g.sum()), int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])), w


def _hits(texts: DataFrame, rule: Rule) -> DataFrame:
    """(bundle, kind, key): what repeats by a rule, told to each bundle it concerns."""
    entries = texts.select(F.col("__bundle").alias("bundle"), "text").mapInArrow(lambda batches: _entries(batches, rule), ENTRY)
    codes = written(entries.repartition("shard_key").mapInArrow(_resolve, "bundle long, kind int, key long"), "suffixes")
    by_text, by_code = texts.groupBy("__bundle"), codes.where(F.col("kind") != FULL).groupBy("bundle")
    strings = by_text.cogroup(by_code).applyInArrow(lambda t, h: _strings(t, h, rule), "key long, bundle long, places int, asked boolean")
    counted = strings.withColumn("n", F.sum("places").over(Window.partitionBy("key")))
    singles = counted.where("asked and n > 1").select("bundle", F.lit(0).alias("kind"), "key")
    return codes.unionByName(singles.distinct())


def bundled(docs: DataFrame, bundle: int = BUNDLE) -> DataFrame:
    """Every row with `__bundle`, which `bundle` rows share whatever their ids (about so many if ids lie far apart)."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.agg(F.count("*").alias("n"), F.count_distinct(doc_id).alias("ids"), F.min(doc_id).alias("a"), F.max(doc_id).alias("b")).first()
    if rows["ids"] < rows["n"]:  # missing or repeated ids tell rows apart no more: their numbers are written down with them
        return written(docs.withColumn("__bundle", F.floor(F.monotonically_increasing_id() / bundle).cast("long")), "numbered")
    if rows["n"] and rows["b"] - rows["a"] > 8 * rows["n"]:  # far apart ids: bundles by hash, or each text would be one
        return docs.withColumn("__bundle", F.pmod(F.xxhash64(doc_id), F.lit(-(-rows["n"] // bundle))).cast("long"))
    return docs.withColumn("__bundle", F.floor(doc_id / bundle).cast("long"))


def remove_repeats(docs: DataFrame, bundle: int = BUNDLE, rules: tuple[Rule, ...] = (BYTES,), watched: tuple[Rule, ...] = ()) -> DataFrame:
    """Every row with `kept` (binary, the remaining bytes), n_bytes, n_removed, n_spans and n_watched instead of `text`.

    What `watched` rules find stays in the text; n_watched tells how many bytes it is."""
    made = ["kept", "n_bytes", "n_removed", "n_spans", "n_watched"]
    rest = [c for c in docs.columns if c not in ("text", *made)]
    texts = bundled(docs.select(*(F.col(f"`{c}`") for c in rest), "text"), bundle)
    by_text, hits = texts.groupBy("__bundle"), None
    for n, rule in enumerate((*rules, *watched)):
        found = _hits(texts, rule).withColumn("kind", F.col("kind") + F.lit(APART * n))
        hits = found if hits is None else hits.unionByName(found)

    def finish(t: pa.Table, h: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        done = list(_kept(t, h, rules, watched)) if t.num_rows else []
        columns = [[d[1] for d in done], [len(d[1]) + d[2] for d in done], *([d[i] for d in done] for i in (2, 3, 4))]
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.binary(), *[pa.int64()] * 4))]
        return pa.Table.from_arrays([*(t.column(c) for c in rest), *arrays], [*rest, *made])

    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in made[1:])])
    return by_text.cogroup(hits.groupBy("bundle")).applyInArrow(finish, schema)


def op4_suffix_dedup(docs: DataFrame) -> DataFrame:
    """What is left of each text once every repeated string of 400 bytes is gone, and how many of its bytes lie in passages
    of over 50 words that repeat (these stay, unless 400 bytes repeat)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    left = remove_repeats(rows, watched=(PASSAGES,))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("n_watched").alias("n_passage_bytes"))
