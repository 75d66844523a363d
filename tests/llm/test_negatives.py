"""Hard negatives against a plain search, tile products against plain ones, and the SQL."""

import duckdb
import numpy as np
import pytest

from dopplerlake.llm import negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, kept=3):
    ok, seen = [], set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        w = tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)
        if (i, label, w) not in seen:
            seen.add((i, label, w))
            ok.append((i, label, w))
    out = []
    for i, label, v in ok:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in ok if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            window = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:kept]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(window)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_product_is_exact_for_all_shapes():
    rng = np.random.default_rng(1)
    for m, n, d in [(1, 1, 1), (17, 33, 64), (40, 100, 65), (64, 64, 64), (129, 70, 31), (35, 35, 200), (50, 0, 64), (0, 5, 64), (3, 3, 0)]:
        a, b = rng.integers(-(2**28), 2**28, (m, d)), rng.integers(-(2**28), 2**28, (n, d))
        assert (negatives.product(a, b) == a @ b.T).all() and negatives.product(a, b).shape == (m, n)
        assert (negatives.product(a, b, leaf=2) == a @ b.T).all()
    big = rng.integers(-(2**62), 2**62, (40, 40))  # sums of parts overflow, the result does not
    assert (negatives.product(big, np.eye(40, dtype=np.int64)) == big).all()


def test_scores_beyond_a_long_are_refused():
    a = np.full((2, 64), 2**31)
    with pytest.raises(ArithmeticError):
        negatives.scores(a, a)
    signs = np.where(np.arange(64) % 2, 1, -1)
    assert (negatives.scores(a, a * signs) == 0).all()  # parts overflow, sums do not


def test_best_keeps_ties_to_the_left():
    none = negatives.NONE
    s = np.array([[5, 7, 7, 1, 7], [none, none, none, none, 3], [none] * 5])
    row, column, score = negatives.best(s, 2)
    assert list(zip(row, column, score)) == [(0, 1, 7), (0, 2, 7), (1, 4, 3)]


def odd_rows():
    v = [0.5, -0.25, 1.0, 0.125]
    return [
        (50, v, 1), (50, v, 1), (100, v, 1), (100, [0.1, 0.2, 0.3, 0.4], 2), (150, [0.0] * 4, 3), (200, [], 1), (250, [0.5, -0.25], 1), (300, None, 1), (350, [1.0, None, 0.0, 0.0], 1),
        (400, [float("nan")] * 4, 1), (450, [float("inf"), 0.0, 0.0, 0.0], 1), (None, v, 1), (500, v, None), (61, v, 1), (62, v, 1), (63, v, 0), (64, v, 1), (65, v, 1), (66, v, 1), (67, v, 1),
        (71, [0.4, -0.2, 0.8, 0.1], 2), (72, [0.4, -0.2, 0.8, 0.1], 2), (73, [0.4, -0.2, 0.8, 0.1], 5), (74, [0.4, -0.2, 0.8, 0.1], 1), (75, [-0.4, 0.2, -0.8, -0.1], 2), (76, [-1e-20, 0.3, 0.0, 0.0], 7),
        (550, [-0.5, 0.25, -1.0, -0.125], 1), (600, v, 9),
    ]


@pytest.mark.parametrize("cells", [negatives.CELLS, 40, 4])
def test_awkward_rows(spark, cells, monkeypatch):
    monkeypatch.setattr(negatives, "FEW", 5)
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, x, "a", 1.0) for i, v, x in rows], SCHEMA + ", anchor string, v double").repartition(3)
    moved = df.selectExpr("vec_id", "case when vec_id % 7 = 0 then (label + 1) % 10 else label end label", "embedding")
    assert collected(negatives.mine(moved, moved.where("vec_id % 50 = 0"), cells=cells)) == plain(rows)
    assert len(plain(rows)) > 20


def test_query_against_plain_search_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = collected(negatives.op11_negatives(spark.read.parquet(f"{SF}/embeddings.parquet")))
    assert got == plain(rows) and got
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(con.execute(negatives.SQL).fetchall()) == got


def test_blocks_do_not_change_a_result(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 24)).astype(np.float32)
    v[:400] = v[0]  # a vector that a third of all rows share
    rows = [(i, v[i].tolist(), int(x)) for i, x in enumerate(np.where(rng.random(1200) < 0.4, 3, rng.integers(0, 10, 1200)))]
    df = spark.createDataFrame(rows, SCHEMA)
    moved = df.selectExpr("vec_id", "case when vec_id % 7 = 0 then (label + 1) % 10 else label end label", "embedding")
    assert collected(negatives.mine(moved, moved.where("vec_id % 50 = 0"), cells=2400)) == plain(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.op11_negatives(empty).collect() == []
