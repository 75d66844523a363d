"""Approximate nearest neighbours by additive quantisation (operator 3).

Index: a vector is coded as the sum of one entry from each of `BOOKS` full-dimensional codebooks; codebooks are fitted one
after the other on the residuals of a bounded sample (`SAMPLE` vectors, smallest by hash), and codes come from a beam
search over them, with the norm of each reconstruction stored beside its code. Search: inner products of a query with all
codebook entries make a lookup table; candidates are scored by table look-ups and stored norms; the best `SHORTLIST` of
each chunk are reranked exactly on the original vectors.

Every vector lies in the coarse cell of its nearest centre (spherical k-means on the sample, one cell for each `CELL`
vectors, `CELLS` at most), and a query visits the `PROBES` cells whose centres are nearest to it. Up to PROBES cells the search
visits all. A cell of more than `CHUNK` vectors has a second level: about one in CHUNK of its own vectors, chosen by hash, are
the centres of its parts, and a query visits the `PARTS` parts nearest to it in each cell. So a query's cost, and the copies of
a vector for the queries that meet it, stay the same however large the table is. Parts still above CHUNK are split by hash,
and so are the queries of a part beyond `BLOCK`, so no group grows with the table. The originals travel with their codes: a
shortlist of hundreds for one query in fifty would fetch each of them several times.

Equal vectors are indexed once, with their `k + 1` smallest different ids, which is all that an exact answer can use. Only codebooks and
centres are broadcast, of a fixed size.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part. All
others are scaled by a power of two first, so that no square overflows or vanishes; the cosine is the same. Ties go to the
smaller vec_id. Exact repeats of a row count once, as candidates and as queries. Rows that share an id but not their vector are
rows of their own, each a query, but none is a neighbour of another. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

BOOKS = 16
ENTRIES = 256
BEAM = 4
SAMPLE = 8192
SHORTLIST = 256
CELL = 8192
CELLS = 2048
PROBES = 16
CHUNK = 16_384
PARTS = 4
BLOCK = 4096
K = 5


def fit_books(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Full-dimensional codebooks (books, entries, d): k-means on what the books before leave of the sample."""
    rng, out, rest = np.random.default_rng(seed), [], x.astype(np.float32).copy()
    for _ in range(books):
        c = rest[rng.choice(len(rest), entries, replace=len(rest) < entries)].copy()
        for _ in range(rounds):
            near = ((c * c).sum(1) - 2 * rest @ c.T).argmin(1)
            n = np.bincount(near, minlength=entries)
            sums = np.zeros_like(c)
            np.add.at(sums, near, rest)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
            c[n == 0] = rest[rng.choice(len(rest), int((n == 0).sum()))]
        rest -= c[((c * c).sum(1) - 2 * rest @ c.T).argmin(1)]
        out.append(c)
    return np.stack(out)


def fit_centres(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 4) -> np.ndarray:
    """Centres (cells, d) of unit length by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = (x.astype(np.float32) @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes by beam search over the codebooks, and norms of the reconstructions."""
    m, e, d = books.shape
    n = len(x)
    codes = np.empty((n, m), np.uint8)
    norms = np.empty(n, np.float32)
    for at in range(0, n, 1024):
        v = x[at : at + 1024].astype(np.float32)
        rest, picked = v[:, None, :], np.zeros((len(v), 1, 0), np.uint8)
        for b in range(m):
            c = books[b]
            cost = (rest * rest).sum(2)[:, :, None] - 2 * rest @ c.T + (c * c).sum(1)
            flat = cost.reshape(len(v), -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            parent, entry = best // e, best % e
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - c[entry]
            picked = np.concatenate([np.take_along_axis(picked, parent[:, :, None], 1), entry[:, :, None].astype(np.uint8)], 2)
        win = (rest * rest).sum(2).argmin(1)
        i = np.arange(len(v))
        codes[at : at + 1024] = picked[i, win]
        norms[at : at + 1024] = np.linalg.norm(v - rest[i, win], axis=1)
    return codes, np.maximum(norms, 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], column.type)
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    # powers of two: exact, and no product of scaled components can overflow
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) if x.size else x


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return ok.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def _index(shared):
    """Adds code, norm and cell to distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, centres = shared.value
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("v")))
                codes, norms = encode(x, books)
                cell = (x.astype(np.float32) @ centres.T).argmax(1).astype(np.int32)
                made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array(cell)]
                yield pa.RecordBatch.from_arrays([b.column("ids"), b.column("v"), *made], ["ids", "v", "code", "norm", "cell"])

    return run


def _probe(shared, probes: int):
    """Adds the cells that a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, centres = shared.value
        n = min(probes, len(centres))
        for b in batches:
            if b.num_rows:
                near = np.argpartition(-(_matrix(b.column("v")).astype(np.float32) @ centres.T), n - 1, axis=1)[:, :n].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * n, pa.int32()), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "cells"])

    return run


def _nearest_parts(n: int, names: list[str], kinds: list[pa.DataType]):
    """Rows (`v` among the columns) with the places of the `n` centres of their cell nearest to them, as the list `parts`."""

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        near = np.zeros((rows.num_rows, 1), np.int32)
        if rows.num_rows and centres.num_rows:
            order = np.argsort(centres.column("part").to_numpy())
            c = unit(_matrix(centres.column("v"))[order]).astype(np.float32)
            k = min(n, len(c))
            near = np.concatenate([np.argpartition(-(_matrix(rows.column("v"))[at : at + 4096].astype(np.float32) @ c.T), k - 1, axis=1)[:, :k] for at in range(0, rows.num_rows, 4096)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
        return pa.table([*(rows.column(c).cast(k) for c, k in zip(names, kinds)), lists], [*names, "parts"])

    return run


def _in_parts(rows: DataFrame, centres: DataFrame, key: str, n: int, chunk: int) -> DataFrame:
    """Rows (with `cell`) once for each of the `n` parts nearest to them in their cell (column `part`; 0 in cells without parts).

    The rows of a cell meet its centres in slices of `chunk`; rows of cells without centres meet nothing.
    """
    held = centres.groupBy("cell").agg(F.count("*").alias("m"))
    split = rows.join(held, "cell", "left_semi")
    slices = split.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("slices"))
    left = split.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64(key, F.lit(3)), "slices").cast("int")).drop("slices")
    right = centres.join(slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    names, schema = rows.columns, rows.schema
    kinds = [f.type for f in to_arrow_schema(schema)]
    made = left.groupBy("cell", "slice").cogroup(right.groupBy("cell", "slice")).applyInArrow(_nearest_parts(n, names, kinds), T.StructType([*schema, T.StructField("parts", T.ArrayType(T.IntegerType()))]))
    met = made.select(*names, F.explode("parts").alias("part"))
    return met.unionByName(rows.join(held, "cell", "left_anti").withColumn("part", F.lit(0)))


def _search(shared, k: int, shortlist: int):
    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        out = {"asked": [], "query_id": [], "vec_id": [], "score": []}
        if c.num_rows and q.num_rows:
            books, _ = shared.value
            m, e, _ = books.shape
            ids = c.column("ids").combine_chunks()
            ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
            owner = np.repeat(np.arange(c.num_rows), np.diff(ids.offsets.to_numpy()))
            every = ids.flatten().to_numpy()
            least = every[np.searchsorted(owner, np.arange(c.num_rows))]
            order = np.argsort(least, kind="stable")
            x = _matrix(c.column("v"))[order]
            members = np.split(every, np.searchsorted(owner, np.arange(1, c.num_rows)))
            members = [members[i] for i in order]
            codes = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(-1, m)[order]
            norm = c.column("norm").to_numpy()[order]
            length = np.sqrt((x * x).sum(1))
            y, y_ids, asked = _matrix(q.column("v")), q.column("query_id").to_numpy(), q.column("asked").to_numpy()
            width = min(shortlist, len(x))
            for at in range(0, len(y), 64):
                part = y[at : at + 64]
                tables = np.einsum("qd,med->qme", part.astype(np.float32), books)
                approx = np.zeros((len(part), len(x)), np.float32)
                for j in range(m):
                    approx += tables[:, j, :][:, codes[:, j]]
                approx /= norm
                best = np.argpartition(-approx, width - 1, axis=1)[:, :width]
                for i, near in enumerate(best):
                    v = part[i]
                    exact = (x[near] * v).sum(1) / (length[near] * np.sqrt((v * v).sum()))
                    top = np.lexsort((near, -exact))[: k + 1]
                    pairs = [(w, float(exact[t])) for t in top for w in members[near[t]].tolist() if w != y_ids[at + i]]
                    pairs.sort(key=lambda p: (-p[1], p[0]))
                    for w, s in pairs[:k]:
                        out["asked"].append(asked[at + i])
                        out["query_id"].append(y_ids[at + i])
                        out["vec_id"].append(w)
                        out["score"].append(s)
        kinds = {"asked": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table([pa.array(out[c], kind) for c, kind in kinds.items()], list(kinds))

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, shortlist: int = SHORTLIST, cell: int = CELL, probes: int = PROBES, most: int = CELLS, chunk: int = CHUNK, parts: int = PARTS) -> DataFrame:
    """The k nearest rows (vec_id, embedding) of each query by cosine: query_id, rank, vec_id, score. With as many `probes` and
    `parts` as there are the search visits all; the shortlist alone is then approximate."""
    spark = rows.sparkSession
    all_rows = usable(rows)
    dims = all_rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = dims["d"] if dims else 1
    all_rows = all_rows.where(F.size("v") == d)
    order = Window.partitionBy("v").orderBy("vec_id")
    same = all_rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    same = written(same.select("ids", "v"), "vectors")
    sample = same.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toArrow()
    x = unit(_matrix(sample.column("v"))) if sample.num_rows else np.ones((1, d))
    cells = max(1, min(most, math.ceil(same.count() / cell)))
    shared = spark.sparkContext.broadcast((fit_books(x), fit_centres(x, cells)))
    asked = usable(queries).where(F.size("v") == d).distinct()
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("vec_id", "v").alias("asked"))
    probed = asked.mapInArrow(_probe(shared, probes), "query_id long, v array<double>, asked long, cells array<int>")
    probed = written(probed.select("query_id", "v", "asked", F.explode("cells").alias("cell")), "probes")
    indexed = written(same.mapInArrow(_index(shared), "ids array<long>, v array<double>, code binary, norm float, cell int"), "codes")
    large = indexed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    chosen = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(chunk)) == 0
    centres = indexed.where(chosen).join(large, "cell", "left_semi").select("cell", "v", (F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("v"), "norm")) - 1).cast("int").alias("part"))
    centres = written(centres, "parts")
    placed = written(_in_parts(indexed, centres, "v", 1, chunk), "placed")
    asking = written(_in_parts(probed, centres, "asked", parts, chunk), "asking")
    held = placed.groupBy("cell", "part").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    visits = asking.groupBy("cell", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    plan = held.join(visits, ["cell", "part"])
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(plan, ["cell", "part"]).select("ids", "v", "code", "norm", "cell", "part", part("v", "chunks").alias("chunk"), each("blocks").alias("block"))
    right = asking.join(plan, ["cell", "part"]).select("query_id", "asked", "v", "cell", "part", each("chunks").alias("chunk"), part("asked", "blocks").alias("block"))
    keys = ("cell", "part", "chunk", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(shared, k, shortlist), "asked long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("asked", "query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(rows: DataFrame) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
