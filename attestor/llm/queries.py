"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, lm_score, packing, quality, secrets, simhash, sql, suffix_dedup, token_counts, url_filter, wavelet

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_quality": quality.op4_quality,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_token_ids": wavelet.op6_token_ids,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_near_duplicates": simhash.op8_near_duplicates,
    "op9_packing": packing.op9_packing,
    "op10_secrets": secrets.op10_secrets,
}

SQL = {"op2_url_filter": url_filter.OP2_SQL, "op4_quality": sql.quality_sql(), "op10_secrets": sql.secrets_sql()}
