"""Queries of the training-data operators over the given tables, and SQL where it can express them."""

from __future__ import annotations

from .ann import op3_ann
from .bpe import op2_bpe_round_trip
from .common import table
from .crf import op6_language
from .html_text import op7_html_text
from .maxent_lm import op5_maxent
from .media import op10_media
from .negatives import SQL as NEGATIVES_SQL
from .negatives import op11_negatives
from .packing import op9_packing
from .periodic import op12_periodic
from .preference import SQL, op1_preference
from .simhash import op8_simhash
from .suffix_dedup import op4_suffix_dedup
from .url_filter import op13_url_filter


def queries() -> dict:
    over = lambda f, name: lambda spark, sf_dir: f(table(spark, sf_dir, name))
    return {
        "op1_preference": over(op1_preference, "conversations"),
        "op2_bpe": over(op2_bpe_round_trip, "documents"),
        "op3_ann": over(op3_ann, "embeddings"),
        "op4_suffix_dedup": over(op4_suffix_dedup, "documents"),
        "op5_maxent": over(op5_maxent, "documents"),
        "op6_language": over(op6_language, "documents"),
        "op7_html_text": over(op7_html_text, "pages"),
        "op8_simhash": over(op8_simhash, "documents"),
        "op9_packing": over(op9_packing, "documents"),
        "op10_media": over(op10_media, "documents"),
        "op11_negatives": over(op11_negatives, "embeddings"),
        "op12_periodic": over(op12_periodic, "documents"),
        "op13_url_filter": lambda spark, sf_dir: op13_url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_preference": SQL, "op11_negatives": NEGATIVES_SQL}
