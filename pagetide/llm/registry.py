"""Queries that apply the operators to their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, decontaminate, line_dedup, mixing, ngram_join, pieces, quality, secrets, substring_dedup, suffix_dedup

QUERIES = {
    "op1_decontamination": decontaminate.op1,
    "op2_quality_classifier": quality.op2,
    "op3_lm_scoring": mixing.op3,
    "op4_ngram_jaccard_join": ngram_join.op4,
    "op5_nearest_neighbours": ann.op5,
    "op6_secret_scan": secrets.op6,
    "op7_sentencepiece": pieces.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_suffix_array_dedup": suffix_dedup.op10,
}

SQL = {
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
}
