"""URL verdicts against a plain reading of the rules, and mined rules against counting all combinations of tokens."""

from collections import Counter
from itertools import combinations

import pytest

from dopplerlake.llm import url_filter as u

SF = "/root/testdata/sf0.001"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = path = ""
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([k for k in (path.find(c) for c in "?#") if k >= 0], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in u.RULES_GIVEN if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


ODD = [
    None, "", "no scheme", "http://", "://", "https://example.com", "https://example.com/", "https://EXAMPLE.com/en/", "https://example.com/EN/x", "https://www.Example.com/en/1", "https://a.www.example.com/en/1",
    "https://xwww.example.com/en/", "https://badexample.com/en/", "https://com/x", "https://notcom/x", "ftp://a.net/es/", "ftp://net/fr/9?x#y", "ftp://a.net/es", "ftp://a.net?/es/", "ftp://a.net#/es/", "https://a.b/c://d.net/fr/",
    "https://ÉX.net/fr/é", "https://x.net:80/es/", "https://x.org/a/12.html?k=v&k=w&&z#f", "https://x.org/%20/a-b_c/" + "y/" * 3000, "https://spam-farm.example.org/es/7", "\n://a.net/fr/\n",
]


def test_hosts_paths_and_given_rules(spark):
    rows = [(k, url, 1.0) for k, url in enumerate(ODD)] + [(None, "https://x.net/es/1", 1.0), (3, "https://x.com/", 2.0), (3, "https://x.com/", 2.0)]
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string, host double").repartition(3), u.RULES_GIVEN, []).collect()
    want = []
    for k, url, _ in rows:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        want.append((k, host, path, rule, verdict or "allow"))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert {r["rule"] for r in got} == {None, "com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/"}


def test_tokens(spark):
    row = u.parts(spark.createDataFrame([("HTTPS://m.spam-farm.Example.org/en/12/a_b.html?ref=x&page=2&ref=y#top",)], "url string")).select(u.tokens().alias("t")).first()
    assert set(row["t"]) == {"s:https", "h:m", "h:spam-farm", "h:spam", "h:farm", "h:example", "h:org", "p:en", "p:#", "p:a", "p:b", "p:html", "q:ref", "q:page", "f:"}
    assert len(row["t"]) == len(set(row["t"]))


def plain_mine(baskets, support, least, confidence):
    n, both, one = len(baskets), Counter(), Counter()
    for ts, blocked in baskets:
        for k in range(1, len(ts) + 1):
            for c in combinations(sorted(ts), k):
                one[c] += 1
                both[c] += blocked
    ok = {c: both[c] / one[c] for c in one if both[c] / n >= max(support, least / n) - 1e-12 and both[c] / one[c] >= confidence}
    return {c: v for c, v in ok.items() if not any(set(d) < set(c) and ok[d] >= v for d in ok)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_against_counting(spark, seed):
    import random

    rng = random.Random(seed)
    baskets = []
    for _ in range(400):
        ts = {t for t, p in zip("abcdefg", (0.6, 0.5, 0.3, 0.3, 0.2, 0.2, 0.1)) if rng.random() < p}
        baskets.append((sorted(ts), rng.random() < (0.9 if {"a", "c"} <= ts else 0.75 if "g" in ts else 0.2)))
    baskets += [(["a", "c", "e"], True)] * 200  # a third of all rows are one basket
    df = spark.createDataFrame(baskets, "tokens array<string>, blocked boolean").repartition(5)
    got = u.mine(df, support=0.01, least=8, confidence=0.5)
    want = plain_mine(baskets, 0.01, 8, 0.5)
    assert {r[2] for r in got} == set(want)
    assert all(abs(r[0] - want[r[2]]) < 1e-9 for r in got)
    judged = df.select("tokens", u.best_mined(got).alias("m")).collect()
    for r in judged:
        fits = [(c, s, ts) for c, s, ts in got if set(ts) <= set(r["tokens"])]
        best = max(fits, default=None)
        assert (tuple(r["m"]["tokens"]) if r["m"] else None) == (best[2] if best else None)


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "https://x.org/en/5", "h")], "page_id long, url string, html string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["verdict"] for r in u.op13_url_filter(pages, none).collect()] == ["allow"]
    assert u.op13_url_filter(pages.limit(0), none).collect() == []
    odd = spark.createDataFrame([(5, None, None), (None, 0, 1), (5, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r["blocked"] for r in u.labelled(pages, odd).collect()] == [False]


def test_labels_teach_the_rest(spark):
    """All of spam hosts' labelled pages are toxic: their unlabelled pages are blocked, others are not."""
    pages = [(k, f"https://m.{'cheap-pills' if k % 4 == 0 else f'site{k % 7}'}.example.org/de/{k}", "x") for k in range(400)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(200)]
    got = u.op13_url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 400 and all((r["verdict"] == "block") == (r["page_id"] % 4 == 0) for r in got)
    assert all(r["rule"] is None and set(r["mined_tokens"]) <= {"h:cheap", "h:pills", "h:cheap-pills"} for r in got if r["verdict"] == "block")


def test_query_over_the_table(spark):
    pages, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "labels"))
    got = u.op13_url_filter(pages, labels).collect()
    assert len(got) == pages.count()
    for r, (i, url) in zip(sorted(got, key=lambda r: r["page_id"]), sorted((p["page_id"], p["url"]) for p in pages.select("page_id", "url").collect())):
        rule, verdict = plain_rule(*plain_parts(url))
        assert (r["page_id"], r["host"], r["path"], r["rule"]) == (i, *plain_parts(url), rule) and r["verdict"] == (verdict or r["verdict"])
