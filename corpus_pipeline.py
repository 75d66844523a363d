"""Corpus pipeline: language identification, near-dedup, exact-substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; between stages the rows are
written as Parquet to the shared folder and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dopplerlake.llm.common import remainder, written
from dopplerlake.llm.crf import UNKNOWN, identify, learn
from dopplerlake.llm.near_docs import first_of_groups
from dopplerlake.llm.packing import op9_packing
from dopplerlake.llm.suffix_dedup import BYTES, PASSAGES, remove_repeats
from dopplerlake.plans.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this mean posterior of its words' own languages a text is no prose of known languages; mixed texts are far above.
LEAST_CONFIDENCE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose words' languages are told, mixed ones too; a missing label is filled with the main one."""
    ship(spark)
    tagger = learn(docs.where(remainder("doc_id", 4) != 2))
    told = identify(docs.select(*COLUMNS), tagger, ("text", "lang", "source", "n_chars"))
    kept = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("confidence") >= LEAST_CONFIDENCE))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (five-word shingles, Jaccard 0.8 or more): that with the smallest id."""
    ship(spark)
    return first_of_groups(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every repeated passage of over 50 words or of 400 bytes; a character cut in two goes with it."""
    ship(spark)
    left = remove_repeats(docs.select(*COLUMNS), rules=(BYTES, PASSAGES))
    whole = F.try_validate_utf8(F.col("kept").cast("string"))
    repaired = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(whole.isNotNull(), whole).otherwise(F.replace(repaired, F.lit("�"), F.lit("")))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    ship(spark)
    return op9_packing(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
