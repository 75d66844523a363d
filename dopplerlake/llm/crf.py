"""Language identification of code-switched text by a linear-chain CRF (operator 6).

Every word with letters is a position of the chain; its state is its language. Emission features: byte n-grams of the
word between boundary marks (those that touch a mark are affixes) and lexicon entries of frequent words, hashed into
`BUCKETS`; transitions are learned. Posteriors come from forward-backward over the whole text: chains are cut into
segments whose transfer matrices are multiplied, so that all segments of many texts advance together and the result is
exactly that of the plain recursion. The language of a text is the one with the largest mean posterior, which is the score.

The runs of a text, its stretches of words whose own languages are the same, come with their places (`runs`).

The classifier is fitted by gradient ascent on the conditional likelihood of a bounded sample: at most `SAMPLE` texts of
each language with a label (smallest by hash of their id), whole, and of `SAMPLE_BYTES` together, for the `LANGUAGES` most
frequent labels. So what reaches the driver is bounded. Labels are given for whole texts, so code-switched chains
are made from them: every other pair of chains swaps runs of a few to some tens of words, which keep their languages. From
these the transitions learn how long a language lasts and what may follow it. Everything else runs over all rows.

Null text or text without letters: `und`, score 0. Null label: not learned from. No labelled row at all: all `und`.
Ties between languages: the first in alphabetical order. Repeated rows: each gets its row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder

BUCKETS = 1 << 15
SAMPLE = 150
SAMPLE_BYTES = 16 << 20
LANGUAGES = 64
#: Lengths in words of the runs that mixed training chains swap, at least and at most.
RUNS = (4, 60)
LEXICON = 4000
SEGMENT = 32
KEPT = 300_000
CHUNK = 2_000_000
UNKNOWN = "und"


def letters(word: str) -> str:
    return "".join(filter(str.isalpha, word))


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of each word, laid end to end, and each word's first position. Each word has at least one."""
    coded = [b"\x01" + w.encode() + b"\x02" for w in words]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    owner = np.repeat(np.arange(len(coded)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    ids, own = [], []
    h = data.copy()
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        ok = left[: len(h)] >= n
        mixed = h[ok] * np.uint32(0x9E3779B1)
        ids.append(mixed >> np.uint32(17))
        own.append(owner[: len(h)][ok])
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        own.append(np.array([k[0] for k in known]))
        ids.append(np.array([k[1] for k in known], np.uint32) + np.uint32(BUCKETS))
    own_all, ids_all = np.concatenate(own), np.concatenate(ids).astype(np.int64)
    order = np.argsort(own_all, kind="stable")
    own_all, ids_all = own_all[order], ids_all[order]
    return ids_all, np.searchsorted(own_all, np.arange(len(words)))


def segments(lengths: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains laid end to end: each segment's first position, its length, and each chain's first segment."""
    per = -(-lengths // size)
    first = np.concatenate([[0], np.cumsum(per)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], per)
    start = np.repeat(np.cumsum(lengths) - lengths, per) + k * size
    return start, np.minimum(size, np.repeat(lengths, per) - k * size), first


def posteriors(scores: np.ndarray, lengths: np.ndarray, start_w: np.ndarray, trans_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward for chains laid end to end (all lengths positive): state posteriors of each position, and expected transition counts."""
    n, k = scores.shape
    psi = np.exp(scores - scores.max(axis=1, keepdims=True))
    trans, begin = np.exp(trans_w), np.exp(start_w)
    at, size, first = segments(lengths)
    s = len(at)
    order = np.argsort(-size, kind="stable")
    at, size, back = at[order], size[order], np.argsort(order, kind="stable")
    live = np.searchsorted(-size, -np.arange(1, size.max() + 1), "right")
    head = np.zeros(s, bool)
    head[first[:-1]] = True
    head = head[order]

    move = np.broadcast_to(np.eye(k), (s, k, k)).copy()
    for t in range(size.max()):
        m = live[t]
        x = (move[:m].reshape(-1, k) @ trans).reshape(m, k, k)
        if t == 0:
            x[head[:m]] = np.eye(k)
        x *= psi[at[:m] + t][:, None, :]
        move[:m] = x / x.sum(axis=(1, 2), keepdims=True)
    move = move[back]

    chains = np.argsort(-np.diff(first), kind="stable")
    per = np.diff(first)[chains]
    into, out_of = np.empty((s, k)), np.empty((s, k))
    a = np.broadcast_to(begin / begin.sum(), (len(chains), k)).copy()
    for j in range(per[0]):
        c = first[chains[: np.searchsorted(-per, -j, "left")]] + j
        into[c] = a[: len(c)]
        x = np.einsum("ci,cij->cj", a[: len(c)], move[c])
        a[: len(c)] = x / x.sum(axis=1, keepdims=True)
    b = np.ones((len(chains), k))
    for j in range(per[0] - 1, -1, -1):
        m = np.searchsorted(-per, -j, "left")
        c = first[chains[:m]] + j
        out_of[c] = b[:m]
        x = np.einsum("cij,cj->ci", move[c], b[:m])
        b[:m] = x / x.sum(axis=1, keepdims=True)
    into, out_of = into[order], out_of[order]

    alpha, gamma, pairs = np.empty((n, k)), np.empty((n, k)), np.zeros((k, k))
    a = into
    for t in range(size.max()):
        m = live[t]
        x = a[:m] @ trans
        if t == 0:
            x[head[:m]] = a[:m][head[:m]]
        x *= psi[at[:m] + t]
        x /= x.sum(axis=1, keepdims=True)
        a[:m] = x
        alpha[at[:m] + t] = x
    b = out_of
    for t in range(size.max() - 1, -1, -1):
        m = live[t]
        here = at[:m] + t
        g = alpha[here] * b[:m]
        gamma[here] = g / g.sum(axis=1, keepdims=True)
        y = psi[here] * b[:m]
        inner = ~head[:m] if t == 0 else slice(None)
        before = alpha[here[inner] - 1]
        z = (before @ trans) * y[inner]
        pairs += trans * (before.T @ (y[inner] / z.sum(axis=1, keepdims=True)))
        y = y @ trans.T
        b[:m] = y / y.sum(axis=1, keepdims=True)
    return gamma, pairs


class Tagger:
    """Learned weights with a bounded memory of word emissions."""

    def __init__(self, langs: list[str], lexicon: dict[str, int], weights: np.ndarray, start: np.ndarray, trans: np.ndarray):
        self.langs, self.lexicon, self.weights, self.start, self.trans = langs, lexicon, weights, start, trans
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(langs)), np.float32)
        self.used = 0

    def _learn(self, chunks: set[str]) -> None:
        if len(self.rows) + len(chunks) > KEPT:
            self.rows.clear()
            self.used = 0
        words, keys = [], []
        for c in chunks:
            w = c if c.isalpha() else letters(c)
            if w:
                words.append(w)
                keys.append(c)
            else:
                self.rows[c] = -1
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids, first = word_features(part, self.lexicon)
            e = np.add.reduceat(self.weights[ids], first, axis=0)
            while self.used + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(part)] = e
            self.rows.update(zip(keys[at : at + 20_000], range(self.used, self.used + len(part))))
            self.used += len(part)

    def emissions(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all words with letters, how many each text has, and each one's number among the words of its text."""
        every = [w for t in texts for w in t]
        missing = set(every).difference(self.rows)
        if missing:
            if len(self.rows) + len(missing) > KEPT:
                missing = set(every)
            self._learn(missing)
        rows = np.fromiter(map(self.rows.__getitem__, every), np.int64, len(every))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ok = rows >= 0
        return self.table[rows[ok]].astype(np.float64), np.bincount(owner[ok], minlength=len(texts)), place[ok]

    def tag(self, texts: list[str]) -> tuple[list[tuple[str, float, int, int, float]], tuple[np.ndarray, ...]]:
        """(language, score, words, switches between languages, mean posterior of each word's own language) of each text, and all
        runs: (their number in each text; first word, word after the last, language of each)."""
        scores, counts, place = self.emissions([t.lower().split() for t in texts])
        out = [(UNKNOWN, 0.0, 0, 0, 0.0)] * len(texts)
        full = np.flatnonzero(counts)
        none = np.zeros(0, np.int64)
        if not len(full) or not self.langs:
            return out, (np.zeros(len(texts), np.int64), none, none, none)
        gamma, _ = posteriors(scores, counts[full], self.start, self.trans)
        edges = np.cumsum(counts[full]) - counts[full]
        mean = np.add.reduceat(gamma, edges, axis=0) / counts[full][:, None]
        best = gamma.argmax(axis=1)
        turned = np.concatenate([[0], np.diff(best) != 0]).astype(np.int64)
        turned[edges] = 0
        turns = np.add.reduceat(turned, edges)
        sure = np.add.reduceat(gamma.max(axis=1), edges) / counts[full]
        for i, row, n, k, c in zip(full.tolist(), mean, counts[full].tolist(), turns.tolist(), sure.tolist()):
            j = int(row.argmax())
            out[i] = (self.langs[j], float(min(1.0, max(0.0, row[j]))), n, k, c)
        turned[edges] = 1
        first = np.flatnonzero(turned)
        many = np.zeros(len(texts), np.int64)
        many[full] = turns + 1
        return out, (many, place[first], place[np.append(first[1:], len(best)) - 1] + 1, best[first])


def mixed_chains(chains: list[tuple[list[str], np.ndarray]], rng: np.random.Generator) -> list[tuple[list[str], np.ndarray]]:
    """Chains of (words, label of each word): every other pair, in random order, swaps alternate runs of random lengths."""
    order = rng.permutation(len(chains)).tolist()
    out = []
    for n, (i, j) in enumerate(zip(order[::2], order[1::2])):
        (a, la), (b, lb) = chains[i], chains[j]
        if n % 2:
            out += [chains[i], chains[j]]
            continue
        cuts = np.cumsum(rng.integers(*RUNS, min(len(a), len(b)) // RUNS[0] + 1)).tolist()
        edges = [0, *(c for c in cuts if c < min(len(a), len(b))), max(len(a), len(b))]
        sides = ([], []), ([], [])
        for k, (x, y) in enumerate(zip(edges, edges[1:])):
            for side, (w, l) in ((k % 2, (a, la)), (1 - k % 2, (b, lb))):
                sides[side][0].extend(w[x:y])
                sides[side][1].append(l[x:y])
        out += [(w, np.concatenate(l)) for w, l in sides if w]
    if len(order) % 2:
        out.append(chains[order[-1]])
    return out


def fit(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.3, seed: int = 5) -> Tagger:
    """A tagger from (text, language) pairs: stochastic gradient ascent (Adagrad) on the chains' conditional likelihood."""
    langs = sorted({lang for _, lang in rows})
    counts = Counter(w for t, _ in rows for w in map(letters, t.lower().split()) if w)
    lexicon = {w: i for i, (w, _) in enumerate(sorted(counts.most_common(LEXICON), key=lambda x: (-x[1], x[0])))}
    k = len(langs)
    tagger = Tagger(langs, lexicon, np.zeros((BUCKETS + LEXICON, k)), np.zeros(k), np.eye(k))
    chains = []
    for text, lang in rows:
        found = [w for w in map(letters, text.lower().split()) if w]
        chains += [(found[i : i + 200], np.full(min(200, len(found) - i), langs.index(lang))) for i in range(0, len(found), 200)]
    rng = np.random.default_rng(seed)
    chains = mixed_chains(chains, rng)
    sq, sq_t, sq_s = np.full_like(tagger.weights, 1e-6), np.full((k, k), 1.0), np.full(k, 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), 64):
            part = [chains[i] for i in order[at : at + 64]]
            lengths = np.array([len(c[0]) for c in part])
            gold = np.concatenate([c[1] for c in part])
            ids, first = word_features([w for c in part for w in c[0]], lexicon)
            e = np.add.reduceat(tagger.weights[ids], first, axis=0)
            gamma, pairs = posteriors(e, lengths, tagger.start, tagger.trans)
            diff = -gamma
            diff[np.arange(len(gold)), gold] += 1
            g = np.zeros_like(tagger.weights)
            np.add.at(g, ids, np.repeat(diff, np.diff(np.append(first, len(ids))), axis=0) / len(gold))
            sq += g * g
            tagger.weights += rate * g / np.sqrt(sq)
            edges = np.cumsum(lengths) - lengths
            inner = np.delete(np.arange(len(gold)), edges)
            seen = np.bincount(gold[inner - 1] * k + gold[inner], minlength=k * k).reshape(k, k)
            gt = (seen - pairs) / len(gold) - 0.0005 * tagger.trans
            sq_t += gt * gt
            tagger.trans = tagger.trans + rate * gt / np.sqrt(sq_t)
            gs = diff[edges].mean(axis=0)
            sq_s += gs * gs
            tagger.start = tagger.start + rate * gs / np.sqrt(sq_s)
    return tagger


def learn(docs: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, languages: int = LANGUAGES) -> Tagger:
    """Fits on at most `sample` labelled texts of each of the `languages` most frequent labels, smallest by hash of doc_id and
    text, whole, as many as fit in `most_bytes` a label."""
    rows = docs.where(F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return Tagger([], {}, np.zeros((BUCKETS + LEXICON, 0)), np.zeros(0), np.zeros((0, 0)))
    # a hash threshold for each language first, so that only about the sample's texts are sorted
    shares = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.3 * sample / n + 20 / n))))
    near = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.try_element_at(shares, F.col("lang")) * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"))
    ranked = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)
    ranked = ranked.withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    picked = ranked.where(F.col("bytes") <= most_bytes).orderBy("lang", "k").collect()
    return fit([(r["text"], r["lang"]) for r in picked])


RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("lang", T.StringType())])


def identify(docs: DataFrame, tagger: Tagger, extra: tuple[str, ...] = (), runs: bool = False) -> DataFrame:
    """doc_id, `extra` columns, lang_pred, score, n_words, n_switches and confidence of every row; only the text is an input.

    With `runs` also the runs of one language (start, stop, lang): words are numbered from 0 between white space, those without
    letters too; `stop` is the word after the last.
    """
    spark, state = docs.sparkSession, (tagger.langs, tagger.lexicon, tagger.weights.astype(np.float32), tagger.start, tagger.trans)
    shared = spark.sparkContext.broadcast(state)
    keep = ["doc_id", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tagger(*shared.value)
        names = pa.array(t.langs, pa.string())
        for b in batches:
            texts, rows, found, at, total = b.column("text").to_pylist(), [], [], 0, 0
            for i, x in enumerate(texts):
                total += len(x or "")
                if total >= CHUNK or i == len(texts) - 1:
                    told, more = t.tag([y or "" for y in texts[at : i + 1]])
                    rows += told
                    found.append(more)
                    at, total = i + 1, 0
            cols = list(zip(*rows)) or [()] * 5
            made = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()))]
            if runs:
                many, start, stop, lang = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
                cells = pa.StructArray.from_arrays([pa.array(start), pa.array(stop), names.take(pa.array(lang))], ["start", "stop", "lang"])
                made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), cells))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], [*keep, *told_names])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("n_switches", T.LongType()), T.StructField("confidence", T.DoubleType())]
    fields += [T.StructField("runs", T.ArrayType(RUN))] if runs else []
    told_names = [f.name for f in fields]
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])
    return docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"]))).mapInArrow(run, schema)


def op6_language(docs: DataFrame) -> DataFrame:
    """Language of every whole text, learned from the documents that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", remainder("doc_id", 4) == 2)
    tagger = learn(rows.where(~F.col("held_out")))
    return identify(rows, tagger, ("held_out",), runs=True).select("doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches", "runs")
