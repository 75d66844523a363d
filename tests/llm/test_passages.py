"""The pipeline's substring_dedup stage on planted passages, and the word rule against brute force."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from dopplerlake.llm import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, length=51):
    """What is left of each text once its repeated runs of `length` words are gone."""
    found = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", t.encode())] for t in texts]
    runs = Counter(tuple(w for *_, w in f[i : i + length]) for f in found for i in range(len(f) - length + 1))
    left = []
    for t, f in zip(texts, found):
        gone = np.zeros(len(t.encode()), bool)
        for i in range(len(f) - length + 1):
            if runs[tuple(w for *_, w in f[i : i + length])] > 1:
                gone[f[i][0] : f[i + length - 1][1]] = True
        left.append(np.frombuffer(t.encode(), np.uint8)[~gone].tobytes())
    return left


def planted():
    rng = np.random.default_rng(11)
    words = lambda n: [f"{w:x}" for w in rng.integers(0, 1 << 16, n)]
    passages = [words(n) for n in (49, 50, 51, 52, 60, 120)]
    texts = []
    for i in range(300):
        p = passages[i % 6]
        a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist()) if i % 3 == 0 else (0, len(p))
        texts.append((" ", "  ", "\n")[i % 3].join(words(int(rng.integers(0, 90))) + p[a:b] + words(int(rng.integers(0, 90)))))
    return [*texts, "", " ", " ".join(passages[2]), "é " * 130 + "end"]


def test_word_rule_against_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs, bundle=16, rules=(suffix_dedup.PASSAGES,)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_passages_of_51_words_go_and_of_50_stay(spark):
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{w}" for w in rng.integers(0, 10_000, n)]
    long, short = words(51), words(50)
    assert len(" ".join(long)) < 400
    own = [(" ".join(words(40)), " ".join(words(40))) for _ in range(40)]
    texts = [f"{a} {' '.join(long if i % 2 else short)} {b}" for i, (a, b) in enumerate(own)]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()}
    assert got == {i: f"{own[i][0]}  {own[i][1]}" if i % 2 else t for i, t in enumerate(texts)}


def test_windows_of_a_long_text_of_words():
    rng = np.random.default_rng(13)
    text = " ".join(f"{w:x}" for w in rng.integers(0, 64, 30_000)).encode()
    symbols, offsets, _, _ = suffix_dedup.units(np.frombuffer(text, np.uint8), np.array([0, 500, 500, len(text)]), suffix_dedup.PASSAGES)
    whole = suffix_dedup.Scan(symbols, offsets, None, 51, 36)
    got = [x for a, s in suffix_dedup.windows_of(symbols, offsets, 3000, suffix_dedup.PASSAGES) for x in zip((s.anchors[s.core] + a).tolist(), s.reach[s.core].tolist())]
    assert sorted(got) == sorted(zip(whole.anchors.tolist(), whole.reach.tolist()))
