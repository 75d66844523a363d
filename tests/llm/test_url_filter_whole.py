"""Mined rules of any number, over any number of tokens and baskets of any length, against counting all combinations."""

import random
from itertools import combinations

import pytest

from dopplerlake.llm import url_filter as u

SCHEMA = "tokens array<string>, blocked boolean"


def covers(baskets):
    """Token to its baskets, as the bits of a number."""
    out = {}
    for k, (ts, _) in enumerate(baskets):
        for t in ts:
            out[t] = out.get(t, 0) | 1 << k
    return out


def plain_best(tokens, baskets, need, confidence, most=8):
    """(confidence, support) of the best rule that `tokens` hold, by counting all their combinations."""
    at, blocked = covers(baskets), sum(1 << k for k, b in enumerate(baskets) if b[1])
    best, own = None, [t for t in sorted(tokens) if t in at]
    for k in range(1, min(len(own), most) + 1):
        for c in combinations(own, k):
            rows = (1 << len(baskets)) - 1
            for t in c:
                rows &= at[t]
            n, b = rows.bit_count(), (rows & blocked).bit_count()
            if b >= need and b / n >= confidence:
                best = max(best or (0, 0), (b / n, b / len(baskets)))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_models_in_the_plan_and_in_tables_against_counting(spark, seed):
    """With tokens of the same baskets (a and its twins), of all baskets, and of blocked ones only."""
    rng = random.Random(seed)
    baskets = []
    for _ in range(300):
        ts = {"all"} | {t for t, p in zip("abcdef", (0.5, 0.5, 0.4, 0.3, 0.2, 0.1)) if rng.random() < p}
        bad = rng.random() < (0.8 if {"a", "c"} <= ts else 0.6 if "f" in ts else 0.25)
        ts |= {"a2", "a3"} if "a" in ts else set()
        ts |= {"only"} if bad and rng.random() < 0.2 else set()
        baskets.append((sorted(ts), bad))
    model = u.learned(spark.createDataFrame(baskets, SCHEMA).repartition(3), 0.01, 5, 0.5)
    odd = [["a3", "c"], ["a2", "b", "d"], ["all"], ["f"], ["only", "f", "zz"], ["zz"], []]
    rows = odd + [b[0] for b in baskets[:60]]
    urls = spark.createDataFrame([(str(k), ts) for k, ts in enumerate(rows)], "url string, tokens array<string>")
    kept, names = u.planned(model)
    planned = {r["url"]: r["m"] for r in urls.withColumn("tokens", u._items(names)).select("url", u.best_mined(kept).alias("m")).collect()}
    joined = {r["url"]: r["mined"] for r in u.joined(urls, model).collect()}
    assert set(names) == {"a2", "a3"} and u.planned(model, 1) is None
    for k, ts in enumerate(rows):
        want = plain_best(ts, baskets, 5, 0.5)
        for got in (planned[str(k)], joined.get(str(k))):
            assert ((got["confidence"], got["support"]) if got else None) == (pytest.approx(want) if want else None), ts
        assert planned[str(k)] == joined.get(str(k))


def test_every_token_is_mined(spark):
    """300 tokens, each blocked three times in four: more than the 256 that were kept."""
    baskets = [([f"t{k:03d}"], j < 3) for k in range(300) for j in range(4)]
    got = u.mine(spark.createDataFrame(baskets, SCHEMA), 0.0, 3, 0.5)
    assert sorted(got) == [(0.75, 3 / 1200, (f"t{k:03d}",)) for k in range(300)]


def test_long_baskets_keep_all_their_tokens(spark):
    """x and y tell together; each alone tells less than the 12 others in its baskets, which alone were kept."""
    others = [f"o{k:02d}" for k in range(13)]
    baskets = [(["x", "y", *(o for j, o in enumerate(others) if j != k % 13)], True) for k in range(40)]
    baskets += [(others, False)] * 10 + [(["x"], False)] * 60 + [(["y"], False)] * 60 + [([], False)] * 400
    got = u.mine(spark.createDataFrame(baskets, SCHEMA), 0.0, 20, 0.5)
    assert (1.0, 40 / 570, ("x", "y")) in got and all(set(ts) & {"x", "y"} for c, _, ts in got if c == 1)


def test_more_rules_than_the_plan_holds(spark):
    """1,100 hosts, each blocked twice in three times: more rules than the 1,024 that were kept; copies of a URL are all judged."""
    pages = [(3 * k + j, f"https://h{k}.org/en/{3 * k + j}") for k in range(1100) for j in range(3)]
    labels = [(3 * k + j, 1, int(j < 2)) for k in range(1100) for j in range(3)]
    df = spark.createDataFrame(pages + [(9999, None), (None, "https://h7.org/en/21"), (9998, "https://h5.com/"), (9997, "https://new.org/en/")] + [(10**6, "https://h8.org/z")] * 50, "page_id long, url string")
    model = u.learned(u.labelled(df.where("page_id < 3300"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("array_contains(tokens, 'h:org')"), 0.0, 2, 0.6)
    model = u.Model(model.rules.where("size(tokens) = 1 and tokens[0] rlike '^h:h[0-9]+$'"), model.members)
    assert model.rules.count() == 1100 and u.planned(model) is None
    got = u.judge(df, u.RULES_GIVEN, model).collect()
    assert len(got) == 3300 + 54
    assert {(r["host"], r["verdict"]) for r in got} == {(f"h{k}.org", "block") for k in range(1100)} | {("", "allow"), ("h5.com", "allow"), ("new.org", "allow")}
    whole = u.judge(df, u.RULES_GIVEN, model, most=2000).collect()
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, got), key=str)


def test_a_long_path_of_many_pages_is_one_item(spark):
    """Two thousand words that the same pages share; a URL with any of them and nothing else known is judged by them."""
    words = "/".join(f"w{k}" for k in range(2000))
    pages = [(k, f"https://a.org/{words}/{k}") for k in range(40)] + [(k, f"https://b.org/x/{k}") for k in range(40, 200)] + [(500, "https://c.org/w1234")]
    labels = [(k, 1, int(k < 30)) for k in range(200)]
    got = u.op13_url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {*range(40), 500}
    assert {r["confidence"] for r in got if r["verdict"] == "block"} == {0.75}
