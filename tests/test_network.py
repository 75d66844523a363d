"""The gesture network: gradients by differences, the whole fit against one array, and what it learns."""

import numpy as np
import pytest

from dopplerlake.operators import gesture, network


def toy(n=240, seed=1):
    rng = np.random.default_rng(seed)
    y = np.where(np.arange(n) % 6 == 0, 2, np.arange(n) % 2)
    x = rng.normal(size=(n, 5)) + np.array([[2, 0, 0, 0, 0], [0, 2, 0, 0, 0], [0, 0, 2, 2, 0]])[y]
    return x, y, np.arange(n) % 5 == 3


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    layers = [(w, rng.normal(size=b.shape)) for w, b in network.start((4, 6, 5, 3), 2)]
    x, y, weight = rng.normal(size=(9, 4)), rng.integers(0, 3, 9), rng.uniform(0.5, 2, 9)
    g, _ = network.gradient(layers, x, y, weight)
    v = network.packed(layers)
    for i in range(0, v.size, 3):
        step = np.zeros(v.size)
        step[i] = 1e-6
        up, down = (network.gradient(network.unpacked(v + s, layers), x, y, weight)[1] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def plain_fit(x, y, held, hidden, classes, rounds, rate=0.01, decay=1e-4):
    """The fit over one array, layer by layer."""
    count = np.bincount(y[~held], minlength=classes)
    weigh = np.where(count > 0, count.sum() / np.maximum(count, 1) / (count > 0).sum(), 0)
    p = [a.copy() for layer in network.start((x.shape[1], *hidden, classes)) for a in layer]
    m, v, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], (-1, None, None)
    for k in range(1, rounds + 1):
        hid = [x[~held]]
        for i in range(0, len(p) - 2, 2):
            hid.append(np.maximum(hid[-1] @ p[i].T + p[i + 1], 0))
        z = hid[-1] @ p[-2].T + p[-1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - np.eye(classes)[y[~held]]) * weigh[y[~held]][:, None] / (~held).sum()
        g = []
        for i in range(len(p) - 2, -1, -2):
            g = [d.T @ hid[i // 2] + decay * p[i], d.sum(axis=0), *g]
            d = (d @ p[i]) * (hid[i // 2] > 0)
        seen = x[held] if held.any() else x
        for i in range(0, len(p), 2):
            seen = seen @ p[i].T + p[i + 1]
            seen = np.maximum(seen, 0) if i < len(p) - 2 else seen
        right = float((seen.argmax(axis=1) == (y[held] if held.any() else y)).mean())
        if right > best[0]:
            best = (right, k - 1, [a.copy() for a in p])
        for i in range(len(p)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return best


@pytest.mark.parametrize("marked", [True, False])
def test_the_fit_is_that_over_one_array(spark, marked):
    x, y, held = toy()
    held = held & marked
    rows = spark.createDataFrame([(a.tolist(), int(b), bool(c)) for a, b, c in zip(x, y, held)], "window array<double>, target int, validation boolean").repartition(5)
    got = network.fit(rows if marked else rows.drop("validation"), (7, 6), 4, 12)
    right, at, layers = plain_fit(x, y, held, (7, 6), 4, 12)
    assert got.best_round == at and max(got.accuracies) == pytest.approx(right)
    assert np.allclose(network.packed(got.layers), np.concatenate([a.ravel() for a in layers]), atol=1e-9)
    assert got.losses[-1] < got.losses[0]


def test_rare_classes_are_learnt(spark):
    x, y, held = toy(600)
    rows = spark.createDataFrame([(1, i, a.tolist(), int(b), bool(c)) for i, (a, b, c) in enumerate(zip(x, y, held))], "recording_id long, frame_idx long, window array<double>, target int, validation boolean")
    net = network.fit(rows, (8,), 3, 60, rate=0.05).layers
    told = {r["frame_idx"]: int(np.argmax(r["probs"])) for r in gesture.score(rows.where("validation"), net).collect()}
    for k in (0, 1, 2):
        mine = [i for i in told if y[i] == k]
        assert np.mean([told[i] == k for i in mine]) > 0.8


def test_nothing_to_learn_from(spark):
    with pytest.raises(ValueError, match="no window"):
        network.fit(spark.createDataFrame([], "window array<double>, target int"))
