"""Bundles of the substring dedup stay bounded for missing and repeated ids."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from dopplerlake.llm import suffix_dedup
from test_against_brute_force import brute_repeats


@pytest.mark.parametrize("key", ["if(id % 3 = 0, null, id)", "if(id % 3 = 0, 7, id)", "cast(null as long)", "id", "id * 1000003"])
def test_no_bundle_grows_with_a_key(spark, key):
    docs = spark.range(0, 6000, 1, 5).select(F.expr(key).alias("doc_id"), F.lit("same").alias("text"))
    got = suffix_dedup.bundled(docs, 100).groupBy("__bundle").count().agg(F.max("count"), F.sum("count")).first()
    assert got[0] <= 160 and got[1] == 6000


def test_rows_without_ids_lose_what_repeats(spark):
    passage = "".join(chr(97 + (i * 7 + i // 5) % 26) for i in range(420))
    texts = [f"{i}<{passage}>{i}" for i in range(300)] + ["alone", None]
    docs = spark.createDataFrame([(None if i % 3 else 1, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = Counter((None if i % 3 else 1, *x, 0) for i, x in enumerate(brute_repeats(texts)))
    assert Counter(map(tuple, suffix_dedup.op4_suffix_dedup(docs).collect())) == want
