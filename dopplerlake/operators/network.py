"""Fitting the gesture network (F19): small ReLU layers and a softmax, by full gradients that Spark adds up over all windows.

A step is one job: each task forms the gradient of its rows in Arrow batches, a few tasks add up what many formed, and the driver
moves the weights (Adam). What travels is the size of the network, whatever the table; the windows themselves are written once to
the shared folder, so a lost executor costs a task. Gradients are sums over all rows, so cuts into files or tasks change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dopplerlake.plans.session import shared_folder

Layers = list[tuple[np.ndarray, np.ndarray]]
#: Tasks that add up the partial sums of all others.
ADDERS = 4


def start(sizes: tuple[int, ...], seed: int = 7) -> Layers:
    """He initialisation for ReLU layers: (weights, biases) of each."""
    rng = np.random.default_rng(seed)
    return [(rng.normal(0.0, np.sqrt(2 / n), (m, n)), np.zeros(m)) for n, m in zip(sizes, sizes[1:])]


def probabilities(layers: Layers, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Softmax of the last layer, and the inputs of every layer."""
    inputs = []
    for i, (w, b) in enumerate(layers):
        inputs.append(x)
        x = x @ w.T + b
        x = np.maximum(x, 0) if i < len(layers) - 1 else x
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), inputs


def gradient(layers: Layers, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum over rows of the gradient of weight * -log p(y), as one vector, and the sum of that loss."""
    p, inputs = probabilities(layers, x)
    loss = float(-(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
    d = p.copy()
    d[np.arange(len(y)), y] -= 1
    d *= weight[:, None]
    out: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        out = [(d.T @ inputs[i]).ravel(), d.sum(axis=0), *out]
        if i:
            d = (d @ layers[i][0]) * (inputs[i] > 0)
    return np.concatenate(out), loss


def packed(layers: Layers) -> np.ndarray:
    return np.concatenate([a.ravel() for layer in layers for a in layer])


def unpacked(v: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((v[at : at + w.size].reshape(w.shape), v[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


@dataclass
class Fit:
    """The network of the best round, and the course of the fit: loss and accuracies by round."""

    layers: Layers
    best_round: int
    losses: list[float] = field(default_factory=list)
    accuracies: list[float] = field(default_factory=list)


def class_weights(rows: DataFrame, classes: int) -> np.ndarray:
    """n / (classes present * count) of each class, 0 for those that are absent; one row a class comes to the driver."""
    n = np.zeros(classes)
    for r in rows.groupBy("target").agg(F.count("*").alias("n")).collect():
        n[r["target"]] = r["n"]
    return np.where(n > 0, n.sum() / np.maximum(n, 1) / max(1, (n > 0).sum()), 0.0)


def fit(rows: DataFrame, hidden: tuple[int, ...] = (30, 60), classes: int = 10, rounds: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 7, balanced: bool = True) -> Fit:
    """Fits a network to rows of `window` (array of numbers), `target` (class) and, if there, `validation`.

    Rows marked for validation are not learnt from; the round with the best accuracy on them is kept (of several the first), or on
    all rows if none is marked. `decay` pulls weights, not biases, towards zero.
    """
    spark = rows.sparkSession
    if "validation" not in rows.columns:
        rows = rows.withColumn("validation", F.lit(False))
    path = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    rows.select(F.col("window").cast("array<double>").alias("window"), F.col("target").cast("int").alias("target"), F.coalesce("validation", F.lit(False)).alias("validation")).where("window is not null and target is not null").write.parquet(path)
    table = spark.read.parquet(path)
    size = table.where("not validation").agg(F.count("*").alias("n"), F.max(F.size("window")).alias("d")).first()
    if not size["n"]:
        raise ValueError("there is no window to learn from")
    weights = class_weights(table.where("not validation"), classes) if balanced else np.ones(classes)
    layers = start((size["d"], *hidden, classes), seed)
    decays = packed([(np.full(w.shape, decay), np.zeros(b.shape)) for w, b in layers])
    n = packed(layers).size

    def totals(layers: Layers) -> np.ndarray:
        """Gradient, loss, rows and right answers of learnt rows, rows and right answers of the others."""
        shared = spark.sparkContext.broadcast((layers, weights))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net, weigh = shared.value
            total = np.zeros(n + 5)
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("window").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y, held = b.column("target").to_numpy(), b.column("validation").to_numpy(zero_copy_only=False)
                for at in range(0, b.num_rows, 4096):
                    cut = slice(at, at + 4096)
                    learn = ~held[cut]
                    right = probabilities(net, x[cut])[0].argmax(axis=1) == y[cut]
                    g, loss = gradient(net, x[cut][learn], y[cut][learn], weigh[y[cut][learn]])
                    total += np.concatenate([g, [loss, learn.sum(), right[learn].sum(), (~learn).sum(), right[~learn].sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n + 5)
            for b in batches:
                for v in b.column("sums"):
                    total += np.frombuffer(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        few = table.mapInArrow(part, "sums binary").repartition(ADDERS).mapInArrow(add, "sums binary").collect()
        shared.unpersist()
        return np.sum([np.frombuffer(r["sums"]) for r in few], axis=0)

    out = Fit(layers, 0)
    best, moved, first, second = -1.0, packed(layers), np.zeros(n), np.zeros(n)
    for k in range(1, rounds + 1):
        s = totals(layers)
        loss, learnt, right, held, held_right = s[n:]
        told = held_right / held if held else right / learnt
        out.losses.append(loss / learnt)
        out.accuracies.append(told)
        if told > best:
            best, out.layers, out.best_round = told, layers, k - 1
        g = s[:n] / learnt + decays * moved
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        moved = moved - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        layers = unpacked(moved, layers)
    return out
