"""Near-duplicate documents by exact Jaccard similarity of five-word shingles (the pipeline's near_dedup stage).

Nodes are distinct texts. Candidate pairs come from two sources and nothing is taken from either without the check:

1. SimHash of the five-word shingles: links of fingerprints within 4 bits by the balls of operator 8, and equal ones.
   At a similarity of 0.8 about 10 of 64 bits differ, and parts short enough to reach that collide at random in squares
   of the corpus, so the bits alone cannot find such pairs.
2. MinHash: `BANDS` bands of `ROWS` minima each. A pair at 0.8 shares a band with 1 - (1 - 0.8^5)^16 = 0.998.

Members of one bucket are paired with the next `BESIDE` of them in an order of its own for each bucket: all pairs of a
bucket of up to 9, and at most 8 pairs a row of a larger one. This happens in two steps: first the very next member, whose
verified pairs form groups; then the others, but only where the two lie in different groups, since a further link inside a
group changes nothing. So a group of thousands of near copies is linked by its first step and makes no more pairs.

Buckets of more than 9 that hold several groups after that are settled exactly: their members meet in a prefix join. Each
set is ordered from its rarest shingle on; two sets of Jaccard >= `LEAST` share one of their first n - ceil(LEAST n) + 1,
and what follows the first that they share is long enough for the overlap they need. Shingles seen in one group only make
no pairs, and elsewhere the members outside the largest group meet all others.

Pairs are verified by exact Jaccard >= `LEAST` in joins with the sets of shingle hashes (64 bits), and the components of
all verified pairs are the groups.

Texts of under five words are one shingle; texts without words are equal to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import utf8, written
from .simhash import LOWER, SEED, components, near_links

WORDS = 5
LEAST = 0.8
BANDS = 16
ROWS = 5
BESIDE = 8
PIECE = 4096
#: Node ids (8 bytes each) that are broadcast at most.
LISTED = 1 << 20


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every word shingle, in order; none without words."""
    found = text.translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    stops = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))


def majority(hashes: np.ndarray) -> int:
    """SimHash: 64-bit majority vote; zero without shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of the bands of a set of shingles."""
    a, b = _permutations()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PIECE):
        x = hashes[None, at : at + PIECE] * a + b
        x ^= x >> np.uint64(29)
        np.minimum(least, x.min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column("text"))
        fp, keys = np.empty(b.num_rows, np.uint64), np.empty((b.num_rows, BANDS), np.uint64)
        for i in range(b.num_rows):
            h = shingles(data[offsets[i] : offsets[i + 1]].tobytes())
            fp[i], keys[i] = majority(h), bands(h)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("doc_id"), pa.array(fp.view(np.int64)), lists], ["node", "doc_id", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column("text"))
        sets = [np.unique(shingles(data[offsets[i] : offsets[i + 1]].tobytes())).view(np.int64) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])


def in_buckets(nodes: DataFrame) -> DataFrame:
    """(node, root, key): every node in each of its buckets."""
    return nodes.select("node", "root", F.explode(F.concat("bands", F.array("fp"))).alias("key"))


def beside(nodes: DataFrame, nearest: int, farthest: int) -> DataFrame:
    """(a, b): nodes (node, root, fp, bands) of a bucket with the members `nearest` to `farthest` places on, in an order that
    differs from bucket to bucket, where their roots differ."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node")
    ahead = F.array(*(F.lead(F.struct("node", "root"), d).over(order) for d in range(nearest, farthest + 1)))
    other = F.transform(F.filter("ahead", lambda x: x["root"] != F.col("root")), lambda x: x["node"])
    return in_buckets(nodes).withColumn("ahead", ahead).select(F.col("node").alias("a"), F.explode(other).alias("b"))


def unsettled(nodes: DataFrame) -> DataFrame:
    """(node, root): nodes of buckets that hold several roots and more members than `beside` pairs with each other."""
    members = in_buckets(nodes)
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    crowded = sizes.where((F.col("n") > BESIDE + 1) & (F.col("low") < F.col("high"))).select("key")
    return written(members.join(crowded, "key", "left_semi").select("node", "root").distinct(), "unsettled")


def sharing_prefixes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): nodes (node, root) of different roots whose sets (node, grams) can reach LEAST, by the prefix principle."""
    grams = sets.select("node", F.explode("grams").alias("gram"))
    ranked = grams.join(grams.groupBy("gram").agg(F.count("*").alias("often")), "gram")
    sorted_ = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    length = F.size("grams")
    prefix = F.slice("grams", 1, (length - F.ceil(LEAST * length - 1e-9) + 1).cast("int"))
    heads = sorted_.join(nodes, "node").select("node", "root", length.alias("n"), F.posexplode(prefix).alias("at", "head"))
    left = (F.col("n") - F.col("at")).alias("left")
    heads = written(heads.where("head.often > 1").select("node", "root", "n", left, F.col("head.gram").alias("gram")), "heads")
    shares = heads.groupBy("gram", "root").agg(F.count("*").alias("members"))
    largest = shares.groupBy("gram").agg(F.max_by("root", F.struct("members", "root")).alias("largest"), F.count("*").alias("roots"))
    mixed = written(heads.join(largest.where("roots > 1"), "gram"), "mixed")
    a, b = (mixed.select("gram", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "left", "largest"))) for side in "ab")
    sizes = F.least("n_a", "n_b") >= LEAST * F.greatest("n_a", "n_b")
    enough = F.least("left_a", "left_b") >= LEAST / (1 + LEAST) * (F.col("n_a") + F.col("n_b")) - 1e-6
    met = a.where("root_a <> largest_a").join(b, "gram").where(F.expr("root_a <> root_b") & sizes & enough)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller node first."""
    return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Links of fingerprints within 4 bits, as pairs of nodes that have them."""
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    links = near_links(heads.select("fp"))
    ends = [heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab"]
    return links.join(ends[0], "a").join(ends[1], "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))


def sets_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, grams): the set of shingle hashes of each of `nodes`, from texts (node, text)."""
    if nodes.count() <= LISTED:  # else the texts are shuffled to meet them
        nodes = F.broadcast(nodes)
    made = texts.join(nodes, "node", "left_semi").mapInArrow(_sets, "node long, grams array<long>")
    return written(made.groupBy("node").agg(F.first("grams").alias("grams")), "sets")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, grams) have a Jaccard similarity of LEAST or more."""
    a, b = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}"), F.size("grams").alias(f"n_{c}")) for c in "ab")
    close = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") >= LEAST * F.greatest("n_a", "n_b"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return close.where(shared >= LEAST * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts (node, text) have a Jaccard similarity of LEAST or more."""
    involved = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "involved")
    return alike(pairs, sets_of(involved, texts))


def rooted(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """`nodes` with their root by `stars` (node, root): every node that is not its own root."""
    return nodes.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))


def grown(stars: DataFrame, links: DataFrame) -> DataFrame:
    """The stars of the components after further links; what was linked before is in them, so few rounds are left."""
    return components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicate texts: that with the smallest id (a row without an id only if all have none)."""
    keyed = docs.withColumn("__node", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = keyed.select(F.col("__node").alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = texts.mapInArrow(_sketches, "node long, doc_id long, fp long, bands array<long>")
    nodes = written(sketches.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    texts = texts.select("node", "text")
    alone = nodes.withColumn("root", F.col("node"))
    stars = components(verified(ordered(beside(alone, 1, 1).unionByName(by_fingerprint(nodes))), texts))
    stars = grown(stars, verified(ordered(beside(rooted(nodes, stars), 2, BESIDE)), texts))
    grouped = written(rooted(nodes, stars), "rooted")
    rest = unsettled(grouped)
    if not rest.isEmpty():
        sets = sets_of(rest.select("node"), texts)
        more = alike(ordered(sharing_prefixes(rest, sets)), sets)
        grouped = rooted(nodes, grown(stars, more))
    grouped = grouped.select(F.col("node").alias("n"), "least", "root")
    chosen = grouped.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "n")).alias("first"))
    first = written(chosen.select(F.col("first.n").alias("__n"), F.col("first.least").alias("__least")), "first")
    # exact repeats of a row meet in the join already, so taking one of them needs no further shuffle
    keys = ["__node", "__id", "__none"]
    least = [F.col("__n").alias("__node"), F.coalesce("__least", F.lit(0)).cast("long").alias("__id"), F.col("__least").isNull().alias("__none")]
    doc_id = F.col("doc_id").cast("long")
    rows = keyed.withColumns({"__id": F.coalesce(doc_id, F.lit(0)).cast("long"), "__none": doc_id.isNull()})
    return rows.join(first.select(*least), keys, "left_semi").dropDuplicates(keys).drop(*keys)
