"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, html, jaccard, language_model, neighbours, packing, quality, sharding, substring, tokencount
from .sql import ORACLE_SQL

QUERIES = {
    "op1_lm_scoring": language_model.op1_lm_scoring,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_html_extraction": html.op3_html_extraction,
    "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_packing": packing.op7_packing,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
