"""Language-model scoring with a hashed maximum-entropy model (operator 5).

P(word | history) = P(class | history) * P(word | class). The class factor is a softmax over hashed features of the
history: the previous class (n-gram), the nearest frequent word before it (skip), and both together (hashed). The word
factor is the closed-form solution of a softmax with word features alone, smoothed by one. `SINGLES` frequent words are
classes of their own; other words are dealt to `SHAPES` classes by their ending: endings (hashed to `ENDINGS`) that follow
the same frequent words share a class (k-means on counts over all training tokens); the end is a class.

Training sees every training token. One pass counts words (they stay distributed, keyed by a 64-bit hash); one pass counts
(history, class) events, which are sufficient statistics of bounded size; gradients are computed on the partitions of
these events and summed, and weights updated, `STEPS` times. Scoring gathers from the model's tables in numpy batches.
Counts of the `FREQUENT` words (a fixed number) travel to all tasks; all other words meet their counts in a join.

Null or empty text: the end alone. Unknown words: count 0. No training rows: base and score are those of an empty
vocabulary (probability 1). Repeated rows: each is counted and scored. Null doc_id: crc32 of empty text decides.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, remainder, utf8, written

SINGLES, SHAPES = 79, 176
CLASSES = 1 + SINGLES + SHAPES
SKIPS = 1 + SINGLES
ENDINGS = 4096
FREQUENT = 65_536
PAIRS = 4096
STEPS = 12
PARTS = 3
KEPT = 300_000
PIECE = 1_000_000
SEED = 5


def ending(word: bytes) -> int:
    """Hash of a word's last three bytes, closing marks included."""
    return zlib.crc32(word[-3:]) % ENDINGS


def deal_endings(counts: np.ndarray, rounds: int = 25, seed: int = 1) -> np.ndarray:
    """Class of each ending from counts (ENDINGS, SKIPS) of the frequent words before it: spherical k-means on smoothed square roots."""
    total = counts.sum(axis=1, keepdims=True)
    prior = (counts.sum(axis=0) + 1e-9) / (counts.sum() + 1e-9 * SKIPS)
    x = np.sqrt((counts + 20 * prior) / (total + 20))
    mass = total[:, 0]
    order = np.argsort(-mass, kind="stable")
    centres = x[order[:1]]
    rng = np.random.default_rng(seed)
    while len(centres) < SHAPES:  # far and frequent endings first
        far = mass * (1 - (x @ centres.T).max(axis=1)).clip(0) + 1e-12
        centres = np.concatenate([centres, x[[rng.choice(ENDINGS, p=far / far.sum())]]])
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x * mass[:, None])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return 1 + SINGLES + (x @ centres.T).argmax(axis=1)


def features(c1: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows of the weight matrix for a history: bias, previous class, skip, hashed pair."""
    pair = ((c1.astype(np.uint64) * np.uint64(SKIPS) + s.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    return np.stack([np.zeros_like(c1), 1 + c1, 1 + CLASSES + s, 1 + CLASSES + SKIPS + pair.astype(np.int64) % PAIRS], axis=1)


ROWS = 1 + CLASSES + SKIPS + PAIRS


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Words:
    """word -> row of (hash, class, count or -1), kept up to KEPT words."""

    def __init__(self, singles: dict[int, int], frequent: dict[int, int], classes: np.ndarray):
        self.singles, self.frequent, self.classes = singles, frequent, classes
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.hash, self.cls, self.count = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64))

    def look_up(self, words: list[bytes]) -> np.ndarray:
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            return rows
        new = list(dict.fromkeys(words[i] for i in missing.tolist()))
        if len(self.rows) + len(new) > KEPT and self.rows:
            self.clear()
            return self.look_up(words)
        h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in new), np.uint64, len(new)).view(np.int64)
        keys = h.tolist()
        end = self.classes[np.fromiter(map(ending, new), np.int64, len(new))]
        own = np.fromiter(map(self.singles.get, keys, repeat(0)), np.int64, len(new))
        count = np.fromiter(map(self.frequent.get, keys, repeat(-1)), np.int64, len(new))
        self.rows.update(zip(new, range(len(self.hash), len(self.hash) + len(new))))
        self.hash, self.cls, self.count = np.concatenate([self.hash, h]), np.concatenate([self.cls, np.where(own > 0, own, end)]), np.concatenate([self.count, count])
        rows[missing] = np.fromiter((self.rows[words[i]] for i in missing.tolist()), np.int64, len(missing))
        return rows


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each text) in portions of bounded size."""
    data, offsets = utf8(batch.column("text"))
    for i, j in pieces_of(offsets, PIECE):
        yield i, [data[offsets[r] : offsets[r + 1]].tobytes().lower().split() for r in range(i, j)]


def histories(words: Words, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """For all tokens of the texts, ends included: text, row in `words` (-1: end), class, previous class, skip."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    n = int(sizes.sum())
    last = np.cumsum(sizes) - 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    row = np.full(n, -1)
    inner = np.ones(n, bool)
    inner[last] = False
    row[inner] = words.look_up([w for t in texts for w in t])
    cls = np.zeros(n, np.int64)
    cls[inner] = words.cls[row[inner]]
    place = np.arange(n)
    first = (last - sizes + 1)[owner]
    c1 = np.where(place > first, np.concatenate([[0], cls[:-1]]), 0)
    single = np.maximum.accumulate(np.where((cls >= 1) & (cls <= SINGLES), place, -1))
    near = np.concatenate([[-1, -1], single])[:n]
    skip = np.where(near >= first, cls[np.maximum(near, 0)], 0)
    return owner, row, cls, c1, skip


def count_words(train: DataFrame) -> DataFrame:
    """(h, ending, c) of every distinct training word; counted within each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for _, texts in texts_of(b):
                for t in texts:
                    seen.update(t)
                if len(seen) > KEPT:
                    yield emit(seen)
                    seen = Counter()
            yield emit(seen)

    def emit(seen: Counter) -> pa.RecordBatch:
        h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in seen), np.uint64, len(seen)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array([ending(w) for w in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["h", "ending", "n"])

    return train.select("text").mapInArrow(run, "h long, ending int, n long").groupBy("h", "ending").agg(F.sum("n").alias("c"))


def count_endings(train: DataFrame, singles) -> np.ndarray:
    """Counts (ENDINGS, SKIPS) of endings after the nearest frequent word, over all training tokens without a class of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # classes stand for endings here, so that one look-up gives either
        words, seen = Words(singles.value, {}, 1 + SINGLES + np.arange(ENDINGS)), np.zeros(ENDINGS * SKIPS, np.int32)
        for b in batches:
            for _, texts in texts_of(b):
                _, _, cls, _, skip = histories(words, texts)
                m = cls > SINGLES
                seen += np.bincount((cls[m] - 1 - SINGLES) * SKIPS + skip[m], minlength=len(seen)).astype(np.int32)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at].astype(np.int64))], ["cell", "n"])

    t = train.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ENDINGS * SKIPS)
    out[t.column("cell").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(ENDINGS, SKIPS)


def count_events(train: DataFrame, singles, classes) -> DataFrame:
    """(history, cls, n) over all training tokens; at most CLASSES * SKIPS histories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(singles.value, {}, classes.value), np.zeros(CLASSES * SKIPS * CLASSES, np.int32)
        for b in batches:
            for _, texts in texts_of(b):
                _, _, cls, c1, skip = histories(words, texts)
                np.add.at(seen, (c1 * SKIPS + skip) * CLASSES + cls, np.int32(1))
        at = np.flatnonzero(seen)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((part // CLASSES).astype(np.int32)), pa.array((part % CLASSES).astype(np.int32)), pa.array(seen[part].astype(np.int64))], ["history", "cls", "n"])

    return train.select("text").mapInArrow(run, "history int, cls int, n long").groupBy("history", "cls").agg(F.sum("n").alias("n"))


def _gradient(weights, first: bool):
    """Sums over a partition's events how often each (feature, class) fires: observed (told once), and observed minus expected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        seen, diff, fires = np.zeros((ROWS, CLASSES)), np.zeros((ROWS, CLASSES)), np.zeros(ROWS)
        tables = [b for b in batches if b.num_rows]
        if tables:
            t = pa.Table.from_batches(tables)
            hist, back = np.unique(t.column("history").to_numpy(), return_inverse=True)
            n = np.zeros((len(hist), CLASSES))
            np.add.at(n, (back, t.column("cls").to_numpy()), t.column("n").to_numpy())
            for at in range(0, len(hist), 2048):
                h, m = hist[at : at + 2048].astype(np.int64), n[at : at + 2048]
                f, total = features(h // SKIPS, h % SKIPS), m.sum(axis=1)
                d = m - total[:, None] * np.exp(log_softmax(w[f].sum(axis=1)))
                for j in range(f.shape[1]):
                    np.add.at(seen, f[:, j], m)
                    np.add.at(diff, f[:, j], d)
                    np.add.at(fires, f[:, j], total)
        rows = np.flatnonzero(fires)
        binary = lambda x: pa.array([r.astype(np.float32).tobytes() for r in x[rows]], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), binary(seen) if first else pa.nulls(len(rows), pa.binary()), binary(diff)], ["f", "seen", "diff"])

    return run


def train_classes(events: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights (ROWS, CLASSES) after distributed gradient updates; a coordinate's step shrinks with what fires there."""
    spark, w = events.sparkSession, np.zeros((ROWS, CLASSES), np.float32)
    for row in events.groupBy("cls").agg(F.sum("n").alias("n")).collect():
        w[0, row["cls"]] = math.log(row["n"] + 1.0)
    seen = np.zeros((ROWS, CLASSES))
    for step in range(steps):
        shared, diff = spark.sparkContext.broadcast(w), np.zeros((ROWS, CLASSES))
        for r in events.mapInArrow(_gradient(shared, step == 0), "f int, seen binary, diff binary").toLocalIterator():
            if r["seen"] is not None:
                seen[r["f"]] += np.frombuffer(r["seen"], np.float32)
            diff[r["f"]] += np.frombuffer(r["diff"], np.float32)
        shared.destroy()
        # observed plus expected counts bound the curvature along a coordinate; three features beside the bias share a step
        w = (w + (2 / 3) * diff / (2 * seen - diff + 2.0)).astype(np.float32)
    return w


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<long>"


def score(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """Scores rows (doc_id, text, held_out): learns from those not held out, scores all."""
    spark = docs.sparkSession
    train = docs.where(~F.col("held_out"))
    counts = written(count_words(train), "counts")
    n_docs = train.count()
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (totals["n"] or 0) + n_docs, totals["v"] + (1 if n_docs else 0)
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).select("h", "c").toArrow().to_pydict()
    singles = {h: i + 1 for i, h in enumerate(top["h"][:SINGLES])}
    frequent = dict(zip(top["h"], top["c"]))
    shared_singles = spark.sparkContext.broadcast(singles)
    dealt = deal_endings(count_endings(train, shared_singles))
    shared_classes = spark.sparkContext.broadcast(dealt)
    events = written(count_events(train, shared_singles, shared_classes).repartition(PARTS, "history"), "events")
    weights = train_classes(events, steps)

    # the word factor: tokens and distinct words of each class, one more for the unknown word
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    mass[0], kinds[0] = n_docs, 1
    own = F.col("h").isin(list(singles)) if singles else F.lit(False)
    for r in counts.where(~own).groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect():
        mass[dealt[r["ending"]]] += r["c"]
        kinds[dealt[r["ending"]]] += r["k"]
    for h, i in singles.items():
        mass[i], kinds[i] = frequent[h], 1
    within = np.log10(mass + kinds + np.where((np.arange(CLASSES) > SINGLES), 1.0, 0.0) + (mass + kinds == 0))
    h = np.arange(CLASSES * SKIPS)
    f = features(h // SKIPS, h % SKIPS)
    table = np.concatenate([log_softmax(weights[f[a : a + 1024]].sum(axis=1)) for a in range(0, len(h), 1024)]) / math.log(10)
    shared = spark.sparkContext.broadcast((frequent, table.astype(np.float32), within))
    per_token = math.log10(n + v + 1)
    end_base = math.log10(n_docs + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        frequent_, table_, within_ = shared.value
        words, uid = Words(shared_singles.value, frequent_, shared_classes.value), TaskContext.get().partitionId() << 36
        for b in batches:
            for i, texts in texts_of(b):
                k = len(texts)
                owner, row, cls, c1, skip = histories(words, texts)
                inner = row >= 0
                c = np.full(len(row), n_docs)
                c[inner] = words.count[row[inner]]
                known = c > 0
                logs = np.log10(np.maximum(c, 0) + 1.0)
                size = np.bincount(owner, minlength=k)
                base = np.bincount(owner, logs, k) - size * per_token
                model = np.bincount(owner, table_[c1 * SKIPS + skip, cls] + logs - within_[cls], k)
                far = np.flatnonzero(c < 0)
                key, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
                ends = np.zeros(k + 1, np.int64)
                if len(far):
                    o, hh = owner[far], words.hash[row[far]]
                    order = np.lexsort((hh, o))
                    o, hh = o[order], hh[order]
                    new = np.flatnonzero(np.concatenate([[True], (hh[1:] != hh[:-1]) | (o[1:] != o[:-1])]))
                    key, times = hh[new], np.diff(np.append(new, len(hh)))
                    ends = np.searchsorted(o[new], np.arange(k + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (key, times)]
                part = b.slice(i, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + k)), part.column("doc_id"), part.column("held_out"), pa.array(size), pa.array(np.bincount(owner, known, k).astype(np.int64)), pa.array(base), pa.array(model), *lists],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )
                uid += k

    marked = written(docs.select("doc_id", "held_out", "text").mapInArrow(run, SCORED), "scored")
    rare = marked.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("h"), F.col("r.times").alias("t"))
    met = rare.join(counts.select("h", "c"), "h").groupBy("uid").agg(F.sum(F.col("t") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("t").alias("met"))
    more = F.coalesce("more", F.lit(0.0))
    return marked.join(met, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )


def op5_maxent(docs: DataFrame) -> DataFrame:
    """Scores of every whole text; those with crc32(doc_id) mod 7 = 2 are held out of training."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", remainder("doc_id", 7) == 2)
    return score(rows)
