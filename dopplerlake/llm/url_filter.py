"""URL filtering (operator 13): given rules by longest match, and for all other URLs association rules mined by FP-growth.

Given rules name a host and the start of a path; one fits its host and all subdomains, and the longest that fits decides. URLs
that none fits are judged by mined rules: labelled URLs become baskets of tokens (scheme, host labels and their parts, path
words with numbers as one token, query keys, a fragment mark) with their label as one more item, Spark's FP-growth finds the
frequent combinations, and of its association rules those that imply `block` are kept if their confidence and support reach the
bounds and no rule with fewer of the same tokens is as confident. An inverted index leads from a rule's rarest token to the rule:
a URL looks up its own tokens and checks only the rules found there. URLs that no mined rule fits are allowed.

Counts are over all labelled rows; no token, basket or rule is left out for its number. What cannot be in a kept rule is taken
out before the search, without a loss: tokens in fewer blocked baskets than the support asks for are in no rule; tokens of exactly
the same baskets are one item, named by the smallest, which a URL holds with any of them; an item of blocked baskets only is a rule
alone, and any larger rule with it is no more confident; an item of all baskets adds nothing to another. So a path of a thousand
words that many pages share is one item. The number of combinations of the rest is what FP-growth has to list: it may still double
with each token that some baskets of a kind hold and others do not.

Rules and items stay tables. Up to PLANNED rules and names are written into the plan, and judging is one narrow projection over
all rows: no shuffle, no join, no group for a hot host. A larger model judges all different URLs by joins with its tables.

Null URL or one without `://`: empty host and path, no tokens, allowed by the method. Repeated rows, null and repeated ids: a row
each. No labelled rows: no mined rules. Empty table: no rows. Columns other than those named are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The rules of the query's contract (verdict, host, start of the path).
RULES_GIVEN = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "=block"
SUPPORT, LEAST, CONFIDENCE = 0.002, 8, 0.5
#: So many rules, and so many further names of their items, go into the plan; a larger model is joined.
PLANNED = 1024
#: In the order in which rules are preferred: the last but one is minus the number of tokens.
RULE = "struct<confidence:double,support:double,fewer:int,tokens:array<string>>"
TABLE = "confidence double, support double, tokens array<string>"


class Model(NamedTuple):
    """Mined rules (confidence, support, tokens), and the tokens that name each item: token, item, c baskets."""

    rules: DataFrame
    members: DataFrame


def _rest(url: Column) -> Column:
    """What follows the first `://`; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)"))


def parts(urls: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path of column `url`; both empty if it is null or has no `://`."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return urls.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def tokens() -> Column:
    """Distinct tokens of a row with url, host and path."""
    url, low = F.coalesce(F.col("url"), F.lit("")), F.lower("path")
    has = _rest(F.col("url")).isNotNull()
    scheme = F.array(F.concat(F.lit("s:"), F.substring_index(F.lower(url), "://", 1)))
    name = F.split("host", r"\.")
    inner = F.flatten(F.transform(F.filter(name, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    words = F.transform(F.split(low, r"[^\p{L}\p{N}]+"), lambda x: F.when(x.rlike(r"^\p{N}+$"), F.lit("#")).otherwise(x))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    marked = lambda mark, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    mark = F.when(url.contains("#"), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(scheme, marked("h:", F.concat(name, inner)), marked("p:", words), marked("q:", keys), mark)
    return F.when(has, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def pruned(rules: Sequence[tuple[float, float, tuple[str, ...]]]) -> list[tuple[float, float, tuple[str, ...]]]:
    """Rules (confidence, support, tokens) without those of which a part alone is as confident."""
    kept: list[tuple[float, float, tuple[str, ...]]] = []
    for rule in sorted(rules, key=lambda r: (len(r[2]), -r[0], r[2])):
        if not any(k[0] >= rule[0] and set(k[2]) <= set(rule[2]) for k in kept):
            kept.append(rule)
    return sorted(kept, key=lambda r: (-r[0], -r[1], r[2]))


def _itemsets(held: DataFrame, items: DataFrame, need: int) -> DataFrame:
    """Counts c, and b of them blocked, of all combinations of two or more items in `need` blocked baskets or more, by FP-growth."""
    sets = written(held.join(items.select("token", "item"), "token").groupBy("h1", "h2", "part", "blocked", "m").agg(F.collect_set("item").alias("items")).where(F.size("items") > 1).select("blocked", "m", "items"), "sets")
    size = sets.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("blocked"), F.col("m"))), F.lit(0)).alias("b")).first()
    if size["b"] < need:
        return held.sparkSession.createDataFrame([], "tokens array<string>, c long, b long")
    label = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    rows = sets.select(F.concat("items", label).alias("items"), F.explode(F.array_repeat(F.lit(0), F.col("m").cast("int")))).select("items")
    found = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / size["n"]).fit(rows).freqItemsets
    found = written(found.select(F.array_contains("items", BLOCK).alias("blocked"), F.sort_array(F.array_remove("items", BLOCK)).alias("tokens"), "freq").where(F.size("tokens") > 1), "itemsets")
    return found.where("blocked").select("tokens", F.col("freq").alias("b")).join(found.where("not blocked").select("tokens", F.col("freq").alias("c")), "tokens")


def learned(baskets: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> Model:
    """All rules that imply `block`, from baskets (tokens, blocked)."""
    # equal baskets of one partition are one row with their number, so that a very frequent basket stays spread
    kinds = baskets.select(F.sort_array(F.array_distinct("tokens")).alias("tokens"), "blocked", F.spark_partition_id().alias("part")).groupBy("tokens", "blocked", "part").agg(F.count("*").alias("m"))
    kinds = written(kinds, "baskets")
    size = kinds.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("blocked"), F.col("m"))), F.lit(0)).alias("b")).first()
    n, need = size["n"], max(math.ceil(support * size["n"] - 1e-9), least, 1)
    spark = baskets.sparkSession
    if size["b"] < need:
        return Model(spark.createDataFrame([], TABLE), spark.createDataFrame([], "token string, item string, c long"))
    held = kinds.select(F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(1), "tokens").alias("h2"), "part", "blocked", "m", F.explode("tokens").alias("token"))
    total = lambda h: F.sum(F.col(h).cast("decimal(20,0)"))
    # tokens of the same baskets have the same sums of their baskets' hashes (two of 64 bits)
    seen = held.groupBy("token").agg(F.sum("m").alias("c"), F.sum(F.when(F.col("blocked"), F.col("m")).otherwise(0)).alias("b"), total("h1").alias("s1"), total("h2").alias("s2")).where(F.col("b") >= need)
    seen = written(seen, "tokens")
    same = ["c", "b", "s1", "s2"]
    items = written(seen.join(seen.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item", "c", "b"), "items")
    alone = items.where("token = item").select(F.array("item").alias("tokens"), "c", "b")
    several = _itemsets(held, items.where((F.col("b") < F.col("c")) & (F.col("c") < n)), need)
    rules = alone.unionByName(several).select((F.col("b") / F.col("c")).alias("confidence"), (F.col("b") / n).alias("support"), "tokens").where(F.col("confidence") >= confidence)
    return Model(written(rules, "rules"), items.select("token", "item", "c"))


def mine(baskets: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> list[tuple[float, float, tuple[str, ...]]]:
    """All kept rules (confidence, support, tokens) as a list, to look at; the query leaves large models in their tables."""
    return pruned([(r["confidence"], r["support"], tuple(r["tokens"])) for r in learned(baskets, support, least, confidence).rules.collect()])


def planned(model: Model, most: int = PLANNED) -> tuple[list[tuple[float, float, tuple[str, ...]]], dict[str, str]] | None:
    """The kept rules and the further names of their items, if there are at most `most` of each; else None."""
    first = model.rules.limit(most + 1).collect()
    if len(first) > most:
        return None
    kept = pruned([(r["confidence"], r["support"], tuple(r["tokens"])) for r in first])
    used = sorted({t for _, _, ts in kept for t in ts})
    names = model.members.where(F.col("item").isin(used) & (F.col("token") != F.col("item"))).limit(most + 1).collect() if used else []
    return None if len(names) > most else (kept, {r["token"]: r["item"] for r in names})


def joined(urls: DataFrame, model: Model) -> DataFrame:
    """url, and as `mined` the rule that `best_mined` would name, of the different URLs (url, tokens) that a rule fits."""
    counts = model.members.where("token = item").select("item", "c")
    lead = model.rules.select("tokens", F.explode("tokens").alias("item")).join(counts, "item").groupBy("tokens").agg(F.min(F.struct("c", "item"))["item"].alias("lead"))
    rules = model.rules.join(lead, "tokens").select("lead", F.struct("confidence", "support", (-F.size("tokens")).alias("fewer"), "tokens").cast(RULE).alias("rule"))
    held = urls.select("url", F.explode("tokens").alias("token")).join(model.members.select("token", "item"), "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    near = held.select("url", "items", F.explode("items").alias("lead")).join(rules, "lead")
    return near.where(F.forall(F.col("rule.tokens"), lambda t: F.array_contains("items", t))).groupBy("url").agg(F.max("rule").alias("mined"))


def index(rules: Sequence[tuple[float, float, tuple[str, ...]]]) -> dict[str, list[dict]]:
    """Token to rules: each rule under that of its tokens which the fewest rules hold."""
    holders: dict[str, int] = {}
    for _, _, ts in rules:
        for t in ts:
            holders[t] = holders.get(t, 0) + 1
    out: dict[str, list[dict]] = {}
    for c, s, ts in rules:
        out.setdefault(min(ts, key=lambda t: (holders[t], t)), []).append({"confidence": c, "support": s, "fewer": -len(ts), "tokens": list(ts)})
    return out


def best_mined(rules: Sequence[tuple[float, float, tuple[str, ...]]]) -> Column:
    """The most confident mined rule that a row's `tokens` hold (ties: support, fewer tokens, then tokens), or null."""
    if not rules:
        return F.lit(None).cast(RULE)
    posts = index(rules)
    lists = F.from_json(F.lit(json.dumps(posts)), f"map<string,array<{RULE}>>")
    own = F.array_intersect("tokens", F.array(*map(F.lit, sorted(posts))))
    near = F.flatten(F.transform(own, lambda t: F.element_at(lists, t)))
    return F.array_max(F.filter(near, lambda r: F.forall(r["tokens"], lambda t: F.array_contains("tokens", t))))


def given(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest given rule (verdict, host, start of path) that fits the row's host and path, or null; ties: the longer host."""
    if not rules:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    fits = [
        F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def _items(names: Mapping[str, str]) -> Column:
    """A row's tokens, each by the name of its item."""
    if not names:
        return F.col("tokens")
    item = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    return F.array_distinct(F.transform("tokens", lambda t: F.coalesce(F.try_element_at(item, t), t)))


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]], mined: Model | Sequence[tuple[float, float, tuple[str, ...]]], most: int = PLANNED) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule that decided, of every row with page_id and url."""
    rows = parts(urls.select("page_id", F.col("url").cast("string").alias("url"))).withColumn("given", given(rules))
    small = planned(mined, most) if isinstance(mined, Model) else (mined, {})
    if small is not None:
        rows = rows.withColumn("tokens", tokens()).withColumn("tokens", _items(small[1])).select("page_id", "host", "path", "given", best_mined(small[0]).alias("mined"))
    else:
        others = parts(rows.where("given is null and url is not null").select("url").distinct()).select("url", tokens().alias("tokens"))
        rows = rows.join(joined(others, mined), "url", "left")
    ruled = F.col("given").isNotNull()
    verdict = F.when(ruled, F.col("given.verdict")).when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), F.when(~ruled, F.col("mined.tokens")).alias("mined_tokens"), F.when(~ruled, F.col("mined.confidence")).alias("confidence"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Baskets (tokens, blocked) of the pages whose URL's last number is a labelled document: blocked if toxic or of quality 0."""
    truth = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).where("toxic is not null or quality is not null")
    truth = truth.select("doc", (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("blocked"))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[^/]*)?/?$", 1)
    rows = parts(pages.select(F.col("url").cast("string").alias("url"))).withColumn("doc", F.when(number != "", number).cast("long"))
    return rows.where("doc is not null").withColumn("tokens", tokens()).join(truth, "doc").select("tokens", "blocked")


def op13_url_filter(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Judges every page's URL by the given rules, else by rules mined from the labelled pages."""
    return judge(pages, RULES_GIVEN, learned(labelled(pages, labels)))
