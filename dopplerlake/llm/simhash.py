"""SimHash near-dedup by meet-in-the-middle ball hashing (operator 8).

Fingerprints: 64-bit majority vote over the XXH64 of all word shingles. Two fingerprints at `radius` 4 or less differ in
at most 2 bits in one of their two 32-bit halves. Each distinct fingerprint therefore emits, for either half, every
variant of it within half of that (1 flip: 33 variants); fingerprints shuffle on (half, variant), meet in the middle, and
colliding pairs are verified on all 64 bits. Emitting the full ball of 2 flips in 64 bits costs 2,081 rows instead of 66.

A variant that more than `PAIRED` distinct fingerprints share is not paired at all: its members go to the full-width
ball (all variants within 2 flips of 64 bits). There members of one variant lie within 2 + 2 flips of each other by the
triangle inequality, so each is linked to the variant's smallest member: exact, with one edge for each row and no pairs.

Components: alternating large-star and small-star steps over the links of distinct fingerprints, each step written to
the shared folder; documents join them by fingerprint at the end. Exact copies share a fingerprint and never form pairs.

Null text, empty text or text without words: fingerprint zero. Repeated rows: each gets its row. Null doc_id: kept as
a row, and never the component's id unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, utf8, written

WORDS = 4
SEED = 42
RADIUS = 4
PAIRED = 1024
#: The bytes that part words, and A-Z to a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit majority vote over the XXH64 of the text's word shingles; zero without words."""
    found = text.translate(LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_digest
    stops = ends[min(words, len(found)) - 1 :] - 1
    ones = np.zeros(64, np.int64)
    for at in range(0, k, 8192):
        hashed = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[at : min(at + 8192, k)].tolist(), stops[at : at + 8192].tolist())])
        ones += np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > k).tobytes(), "big")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            out = np.empty(b.num_rows, np.uint64)
            for i in range(b.num_rows):
                out[i] = fingerprint(data[offsets[i] : offsets[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _half_variants(fps: DataFrame) -> DataFrame:
    """(half, variant, fp): both 32-bit halves with each bit flipped or none."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(32)))
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    sides = F.array(F.struct(F.lit(0).alias("half"), low.alias("part")), F.struct(F.lit(1).alias("half"), high.alias("part")))
    return (
        fps.select("fp", F.explode(sides).alias("side"))
        .select("fp", "side.half", "side.part", F.explode(flips).alias("flip"))
        .select((F.shiftleft(F.col("half").cast("long"), 40) + F.col("part").bitwiseXOR(F.col("flip"))).alias("variant"), "fp")
    )


def _links_of_runs(radius: int, most: int):
    """Streams runs of equal variants: runs up to `most` give a spanning forest of verified links, longer ones only members."""

    def links(fps: np.ndarray) -> list[tuple[int, int]]:
        fps = np.unique(fps)
        root = np.arange(len(fps))
        out = []
        for i in range(1, len(fps)):
            near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)
            if not len(near):
                continue
            for r in np.unique(root[near]).tolist():
                j = near[root[near] == r][0]
                out.append((int(fps[j]), int(fps[i])))
                root[root == r] = i
            root[i] = i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            a = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        key, held, long_run = None, np.zeros(0, np.uint64), False
        for b in batches:
            v, fp = b.column("variant").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(v)) + 1, [len(v)]])
            out: list[tuple[int, int]] = []
            sizes = np.diff(cuts)
            inner = np.flatnonzero(sizes == 2)
            inner = inner[(inner > 0) & (inner < len(sizes) - 1)]
            x, y = fp[cuts[inner]], fp[cuts[inner] + 1]
            near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
            out += zip(x[near].tolist(), y[near].tolist())
            for i in np.flatnonzero((sizes > 2) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)).tolist():
                part, k = fp[cuts[i] : cuts[i + 1]], v[cuts[i]]
                if k != key:
                    if len(held) > 1 and not long_run:
                        out += links(held)
                    key, held, long_run = k, np.zeros(0, np.uint64), False
                if long_run:
                    out += [(int(x), int(x)) for x in part]
                    continue
                held = np.concatenate([held, part])
                if len(held) > most:
                    out += [(int(x), int(x)) for x in held]
                    held, long_run = np.zeros(0, np.uint64), True
            if out:
                yield batch(out)
        if len(held) > 1 and not long_run:
            yield batch(links(held))

    return run


def _full_ball_links(fps: DataFrame) -> DataFrame:
    """Links of fingerprints that share a variant within 2 flips of 64 bits: each member to the variant's smallest."""
    flips = F.expr("concat(array(0L), flatten(transform(sequence(1, 64), i -> transform(sequence(0, i - 1), j -> if(i < 64, shiftleft(1L, i), 0L) ^ shiftleft(1L, j)))))")
    balls = fps.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp")
    least = balls.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("variant", "a")
    return balls.join(least, "variant").where("fp > a").select("a", F.col("fp").alias("b")).distinct()


def near_links(fps: DataFrame, radius: int = RADIUS, most: int = PAIRED) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, enough that their components are those of all pairs within `radius`."""
    if radius != 4:
        raise ValueError("the two balls of one flip a half hold for radius 4")
    runs = _half_variants(fps).repartition("variant").sortWithinPartitions("variant")
    found = written(runs.mapInArrow(_links_of_runs(radius, most), "a long, b long").distinct(), "links")
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    links = found.where("a <> b")
    if not crowded.isEmpty():
        links = links.unionByName(_full_ball_links(crowded))
    return links


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (a, b) is either a leaf of one edge or a centre: then `b` is the component of `a`."""
    leaves = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    centres = edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    ends = leaves.unionByName(centres).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.where("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every linked node that is not its own root; large-star and small-star by turns."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not are_stars(edges):  # every edge leads to a smaller node, so the centre of a star is its smallest
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.where("a <> b").distinct(), "small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links of radius 4) of every row."""
    marked = written(with_fingerprint(docs), "fingerprints")
    ids = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = written(ids, "distinct")
    roots = components(near_links(nodes.select("fp")))
    grouped = written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(docs: DataFrame) -> DataFrame:
    """Fingerprint in hex and component of every document."""
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
