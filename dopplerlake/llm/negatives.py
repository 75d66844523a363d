"""Hard-negative mining (operator 11): exact integer inner products by Strassen multiplication of tiles, kept in mergeable heaps.

Vectors become integers (floor(256 * x)). Anchors and candidates are dealt into blocks by hash, and each pair of blocks is one
group: a tile product. Two passes: the first multiplies only anchors and candidates of one label and keeps each anchor's best
`POSITIVES`; these fix a window of scores for each positive, and the second keeps, for each anchor and positive, the best
`NEGATIVES` rows of another label within the window. Heaps of different tiles merge by keeping the best again, so no block
size changes a result. Tiles are multiplied by Strassen's recursion in int64 with zero padding to even sizes, down to `LEAF`;
all additions are of integers modulo 2^64, so a score that fits in a long is exact whatever the parts overflow.

The stated query set is compared with all rows, in blocks, so work grows with rows times anchors; a block holds `CELLS` numbers,
whatever the dimension, and a label or vector with a third of all rows is only more blocks. Nothing is broadcast or collected
but the numbers of rows.

Null vec_id, label or vector, and null or non-finite components: the row takes no part. Exact repeats of a row count once; rows
that share an id but differ otherwise are rows of their own, and none is the other's positive or negative. Shorter vectors are
padded with zeros. Scores beyond a long: ArithmeticError. Anchors without positives, windows without rows, empty table: no rows.
Columns other than vec_id, label and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

POSITIVES, NEGATIVES = 5, 3
SCALE = 256
LEAF = 16
CELLS = 1 << 20
SLICE = 4096
FEW = 1024
LEAST_BLOCKS = 64
NONE = np.iinfo(np.int64).min


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, [(0, n % 2) for n in x.shape]) if any(n % 2 for n in x.shape) else x


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Inner products (m, n) of the rows of int64 `a` (m, d) with those of `b` (n, d), by Strassen's seven half-size products."""
    m, n = len(a), len(b)
    if min(m, n, a.shape[1]) <= leaf:
        return a @ b.T
    a, b = _even(a), _even(b)
    i, j, k = len(a) // 2, len(b) // 2, a.shape[1] // 2
    # b is held transposed: its upper right quarter is b12 of the right-hand factor's lower left, and so on
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b21, b12, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    p1 = product(a11 + a22, b11 + b22, leaf)
    p2 = product(a21 + a22, b11, leaf)
    p3 = product(a11, b12 - b22, leaf)
    p4 = product(a22, b21 - b11, leaf)
    p5 = product(a11 + a12, b22, leaf)
    p6 = product(a21 - a11, b11 + b12, leaf)
    p7 = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def integers(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles with integer values as int64, padded with zeros to `width`."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(values) and np.abs(values).max() >= 2.0**62:
        raise ArithmeticError("a component's integer is beyond a long")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values.astype(np.int64)
    return out


def _widest(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for column in columns for c in column.chunks if len(c)), default=0)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; ArithmeticError if one is beyond a long."""
    size = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if a.shape[1] * size(a) * size(b) >= 2.0**63 and np.abs(a.astype(np.float64) @ b.T.astype(np.float64)).max(initial=0) >= 2.0**63 * (1 - 1e-9):
        raise ArithmeticError("a score is beyond a long")
    return product(a, b)


def best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k largest cells of each row that are not NONE, ties to the left."""
    k = min(k, s.shape[1])
    least = np.maximum(np.partition(s, -k, axis=1)[:, -k], NONE + 1)
    row, column = np.nonzero(s >= least[:, None])
    score = s[row, column]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.searchsorted(row, np.arange(len(s)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep], score[keep]


def _tiles(c: pa.Table, q: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of c by id, scores): parts of the group's product that hold at most `CELLS` scores or one row."""
    width = _widest(c.column("v"), q.column("v"))
    y, order = integers(q.column("v"), width), np.argsort(c.column("vec_id").to_numpy(), kind="stable")
    x = integers(c.column("v"), width)[order]
    for i in range(0, len(x), SLICE):
        part = x[i : i + SLICE]
        step = max(1, CELLS // len(part))
        for j in range(0, len(y), step):
            yield np.arange(j, min(j + step, len(y))), order[i : i + SLICE], scores(y[j : j + step], part)


def _positives(k: int):
    kind = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        parts = []
        if c.num_rows and q.num_rows:
            ids, key, own = c.column("vec_id").to_numpy(), q.column("anchor").to_numpy(), q.column("anchor_id").to_numpy()
            for rows, near, s in _tiles(c, q):
                s[own[rows][:, None] == ids[near]] = NONE
                row, column, score = best(s, k)
                parts.append([key[rows[row]], own[rows[row]], ids[near[column]], score])
        return pa.table([np.concatenate(x) for x in zip(*parts)], schema=kind) if parts else kind.empty_table()

    return run


def _negatives(k: int):
    kind = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        parts = []
        if c.num_rows and q.num_rows:
            ids, key, own = c.column("vec_id").to_numpy(), q.column("anchor").to_numpy(), q.column("anchor_id").to_numpy()
            label, own_label, windows = c.column("label").to_numpy(), q.column("label").to_numpy(), q.column("windows").to_pylist()
            low, high = np.zeros((2, len(own), max(map(len, windows))), np.int64)
            low += 1  # an empty window
            for i, w in enumerate(windows):
                for j, x in enumerate(sorted(w, key=lambda x: x["place"])):
                    low[i, j], high[i, j] = x["low"], x["high"]
            for rows, near, s in _tiles(c, q):
                s[(own_label[rows][:, None] == label[near]) | (own[rows][:, None] == ids[near])] = NONE
                for j in range(low.shape[1]):
                    row, column, score = best(np.where((s >= low[rows, j, None]) & (s <= high[rows, j, None]), s, NONE), k)
                    parts.append([key[rows[row]], own[rows[row]], np.full(len(row), j + 1), ids[near[column]], score])
        return pa.table([np.concatenate(x) for x in zip(*parts)], schema=kind) if parts else kind.empty_table()

    return run


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v, anchor key) of the rows that take part, v with integer values; exact repeats once."""
    v = F.col("embedding").cast("array<double>")
    ok = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).where("vec_id is not null and label is not null and v is not null")
    ok = ok.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole
    return ok.withColumn("v", F.transform("v", lambda x: whole(x * SCALE))).distinct().withColumn("anchor", F.xxhash64("vec_id", "label", "v"))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), cells: int = CELLS) -> DataFrame:
    """Hard negatives of each anchor and positive: scores from low to high (fractions of the positive's score, exact).

    `rows` and `anchors` hold vec_id, label and embedding. Blocks are of `cells` numbers.
    """
    x = written(usable(rows), "rows")
    a = written(usable(anchors).withColumnRenamed("vec_id", "anchor_id"), "anchors")
    size = x.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    edge = max(1, cells // max(1, size["d"] or 1))
    blocks = lambda n: F.ceil(F.lit(n) / edge if isinstance(n, int) else n / edge).cast("int")
    part = lambda n: F.pmod(F.xxhash64("anchor", F.lit(1)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))

    counts = x.groupBy("label").agg(blocks(F.count("*")).alias("nx")).join(a.groupBy("label").agg(blocks(F.count("*")).alias("na")), "label")
    keys = ("label", "xb", "ab")
    left = x.join(counts, "label").withColumn("xb", part(F.col("nx"))).withColumn("ab", each(F.col("na"))).select(*keys, "vec_id", "v")
    right = a.join(counts, "label").withColumn("ab", part(F.col("na"))).withColumn("xb", each(F.col("nx"))).select(*keys, "anchor", "anchor_id", "v")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_positives(positives), "anchor long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    nearest = written(found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= positives), "positives")

    def bound(fraction: tuple[int, int], up: bool):
        """The positive's score times a fraction, rounded up or down; no product overflows."""
        (n, m), s = fraction, "positive_score"
        return F.expr(f"({s} - pmod({s}, {m}L)) div {m}L * {n}L + ({n}L * pmod({s}, {m}L) + {m - 1 if up else 0}L) div {m}L")

    windows = nearest.groupBy("anchor", "anchor_id").agg(F.collect_list(F.struct("place", bound(low, True).alias("low"), bound(high, False).alias("high"))).alias("windows"))
    wide = max(-(-size["n"] // edge), min(LEAST_BLOCKS, -(-size["n"] // FEW)), 1)
    tall = max(1, -(-a.count() // edge))
    keys = ("xb", "ab")
    left = x.withColumn("xb", part(F.lit(wide))).withColumn("ab", each(F.lit(tall))).select(*keys, "vec_id", "label", "v")
    right = a.join(windows, ["anchor", "anchor_id"]).withColumn("ab", part(F.lit(tall))).withColumn("xb", each(F.lit(wide))).select(*keys, "anchor", "anchor_id", "label", "v", "windows")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_negatives(negatives), "anchor long, anchor_id long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(nearest, ["anchor", "anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(rows: DataFrame) -> DataFrame:
    """Hard negatives of every anchor whose id is divisible by 50; labels of ids divisible by 7 are moved on by one first."""
    label = F.col("label").cast("long")
    moved = rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")
    return mine(moved, moved.where(F.col("vec_id") % 50 == 0))


SQL = """WITH x AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(u AS DOUBLE)) AS DOUBLE) FOR u IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR u IN embedding IF u IS NULL OR NOT isfinite(u)]) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM x a JOIN x b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3"""
