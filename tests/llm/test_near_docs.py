"""The pipeline's near_dedup stage against exact five-word Jaccard similarities."""

import numpy as np

import corpus_pipeline
from dopplerlake.llm import near_docs
from dopplerlake.llm.simhash import fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def edited(words, places):
    return " ".join(f"x{w}" if i in places else w for i, w in enumerate(words))


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], SCHEMA).repartition(5)
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)


def test_near_copies_go_and_texts_below_the_similarity_stay(spark):
    rng = np.random.default_rng(3)
    near, far = [], []
    for i in range(40):
        words = [f"w{n}" for n in rng.integers(0, 5000, 200)]
        near += [(10 * i, " ".join(words)), (10 * i + 1, edited(words, {40, 120, 160}))]
        far += [(10 * i, " ".join(words)), (10 * i + 1, edited(words, set(range(20, 200, 30))))]
    pairs = [(near[i][1], near[i + 1][1]) for i in range(0, 80, 2)]
    assert all(jaccard(*p) >= 0.8 for p in pairs)
    assert any((fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count() > 4 for a, b in pairs)
    assert kept(spark, near) == sorted(near[::2], key=str)
    assert all(jaccard(far[i][1], far[i + 1][1]) < 0.8 for i in range(0, 80, 2))
    assert kept(spark, far) == sorted(far, key=str)


def test_candidates_are_verified(spark):
    words = [f"w{n}" for n in range(60)]
    texts = [" ".join(words), edited(words, {30}), edited(words, {10, 30, 50}), "", "two words"]
    pairs = [(i, j) for j in range(5) for i in range(j)]
    got = near_docs.verified(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
    assert {tuple(r) for r in got.collect()} == {(i, j) for i, j in pairs if texts[i] and jaccard(texts[i], texts[j]) >= 0.8}


def test_a_crowd_of_near_copies_leaves_one(spark):
    words = [f"w{n}" for n in range(300)]
    rows = [(i, edited(words, {(7 * i) % 300})) for i in range(400)]
    assert kept(spark, rows) == [rows[0]]


def test_missing_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{k}{n}" for n in range(60)) for k in "abc")
    rows = [(None, a), (None, a), (5, a), (None, b), (None, b + " end"), (7, c), (7, "some other text of the same id"), (8, None), (9, "")]
    got = kept(spark, rows)
    assert [x for x in got if x[0] is None] in ([(None, b)], [(None, b + " end")])
    assert [x for x in got if x[0] is not None] == [(5, a), (7, c), (7, "some other text of the same id"), (8, None)]


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_docs, "bands", lambda hashes: np.arange(near_docs.BANDS, dtype=np.uint64))  # one bucket for all
    rng = np.random.default_rng(8)
    rows = []
    for i in range(150):
        words = [f"w{n}" for n in rng.integers(0, 5000, 120)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(words, {30, 80}))]
    texts = spark.createDataFrame(rows, "node long, text string")
    nodes = texts.selectExpr("node", "node as root")
    sets = near_docs.sets_of(nodes.select("node"), texts)
    got = near_docs.alike(near_docs.ordered(near_docs.sharing_prefixes(nodes, sets)), sets)
    assert {tuple(r) for r in got.collect()} == {(2 * i, 2 * i + 1) for i in range(150)}
