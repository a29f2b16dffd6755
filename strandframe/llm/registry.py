"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import decontamination, fingerprint_index, jaccard, language_id, line_dedup, mixing, quality, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_fingerprint_index": fingerprint_index.op6_fingerprint_index,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
}
ORACLES = {
    "op1_mixing": mixing.SQL,
    "op2_quality_rules": quality.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op7_decontamination": decontamination.SQL,
    "op8_url_filter": url_filter.SQL,
}
