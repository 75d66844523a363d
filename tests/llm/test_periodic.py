"""Periodic runs against a plain search over all periods, and the digests of the query."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dopplerlake.llm import periodic

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=1):
    """Every maximal stretch with its smallest period, length 3 periods or more, by trying all periods."""
    n, smallest = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j - i >= 2 * p:
                smallest.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in smallest.items() if e - s >= max(least, 3 * p))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def hard_cases():
    rng = np.random.default_rng(4)
    yield from ([], [1], [1, 1], [1, 1, 1], [0] * 100, fibonacci(600), [0, 0, 1] * 90, ([0] * 40 + [1]) * 9, list(range(50)) * 4)
    yield (([0, 1] * 20 + [2]) * 4 + [3]) * 4
    yield [0] * 37 + list(range(1, 30)) * 5 + [0] * 33
    for alphabet in (1, 2, 3, 4):
        for n in (30, 100, 400):
            yield rng.integers(0, alphabet, n).tolist()
    for _ in range(60):  # periods of all sizes, with periodic parts within the period, damaged and clipped
        p = int(rng.integers(1, 90))
        unit = rng.integers(0, 3, p)
        if p > 12 and rng.random() < 0.6:
            unit[2 : p - 3] = np.resize(rng.integers(0, 3, int(rng.integers(1, 5))), p - 5)
        text = np.concatenate([rng.integers(0, 3, int(rng.integers(0, 60))), np.resize(unit, int(p * rng.uniform(2.6, 7))), rng.integers(0, 3, int(rng.integers(0, 60)))])
        if rng.random() < 0.4:
            text[rng.integers(0, len(text))] += 1
        yield text.tolist()


def test_all_runs_are_found():
    for w in hard_cases():
        got = sorted((s, e - s, q) for s, e, q in periodic.runs_of(np.array(w, np.int64)))
        assert got == plain_runs(w), (len(w), w[:80])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), min_size=1, max_size=25), st.integers(2, 6), st.lists(st.integers(0, 2), max_size=40))
def test_all_runs_are_found_around_powers(before, unit, times, after):
    w = before + unit * times + after
    assert sorted((s, e - s, q) for s, e, q in periodic.runs_of(np.array(w, np.int64))) == plain_runs(w)


def test_chosen_positions_depend_on_their_context_alone():
    rng = np.random.default_rng(9)
    w = np.concatenate([np.resize(rng.integers(0, 5, 37), 500), rng.integers(0, 5, 300), np.resize(rng.integers(0, 5, 37), 200)])
    h = w.astype(np.uint64)
    for t in (1, 2, 4):
        h = periodic._mixed(h[:-t], h[t:])
    t = 8
    found = [(s, e) for s, e, q in periodic.runs_of(w) if 3 * q <= t <= e - s]
    chosen, context = set(periodic.synchronising(h, t, found).tolist()), {}
    for i in range(len(w) - 2 * t):
        context.setdefault(tuple(w[i : i + 2 * t].tolist()), set()).add(i in chosen)
    assert all(len(v) == 1 for v in context.values()) and chosen


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words, 24)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_against_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t if len(t or "") < 9000 else t[:9000]) for i, t in rows]  # the plain search is quadratic; whole texts follow below
    odd = [
        (10_000, None), (10_001, ""), (10_002, " \n\t"), (None, "a b " * 40), (None, None), (10_003, "x " * 500), (10_003, "x " * 500), (10_004, "ab cd ef " * 8), (10_005, "ab cd ef " * 7 + "ab cd"),
        (10_006, "  a　b " * 30), (10_007, " ".join(str(i % 60) for i in range(500))), (10_008, "é🙂 ü\x1c " * 20), (10_009, ("a " * 30 + "b ") * 5),
    ]
    tens = [(k, " ".join(f"w{j % (7 + k % 90)}x{j % 5}" for j in range(300 + k % 211))) for k in range(20_000, 20_200)]
    docs = spark.createDataFrame([(i, t, "extra", [1]) for i, t in rows + odd + tens], "doc_id long, text string, collapsed string, runs array<int>").repartition(4)
    got = sorted((tuple(r) for r in periodic.op12_periodic(docs).collect()), key=str)
    want = sorted((expected(*r) for r in rows + odd + tens), key=str)
    assert got == want
    assert sum(r[1] > 0 for r in got) > 20
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.op12_periodic(empty).collect() == []
    assert dict(periodic.op12_periodic(empty).dtypes)["exponent_milli"] == "bigint"


def test_very_long_texts():
    rng = np.random.default_rng(2)
    unit = [f"w{x}".encode() for x in rng.integers(0, 3000, 70_001)]
    noise = [f"n{x}".encode() for x in rng.integers(0, 3000, 250_000)]
    runs = periodic.runs_of_texts([noise + (unit * 4)[:250_000] + noise[:9], [b"a"] * 5, [b"a"] * 300_000])
    assert runs == [[(250_000, 250_000, 70_001)], [], [(0, 300_000, 1)]]


@pytest.mark.parametrize("runs,want", [([(0, 24, 8), (5, 30, 10), (2, 24, 8)], (0, 24, 8)), ([(9, 31, 10), (0, 24, 8)], (9, 31, 10)), ([], None)])
def test_best_run(runs, want):
    assert periodic.best_of(runs) == want
