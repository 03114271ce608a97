"""Queries and oracle SQL of the training-data operators, for the driver's entry module."""

from __future__ import annotations

from factweave.llm import decontaminate, line_dedup, lm_score, manifest, mixing, ngram_join, pii, quality, secrets, sharding, spelling, substring_dedup, urls

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_sharding": sharding.op6_sharding,
    "op7_personal_data": pii.op7_personal_data,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_url_reputation": urls.op10_url_reputation,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
ORACLE_SQL = {
    "op9_quality_rules": quality.OP9_SQL,
    "op10_url_reputation": urls.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_merkle_manifest": manifest.OP12_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}
