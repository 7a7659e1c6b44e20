"""Registered queries of this package and their SQL."""

from __future__ import annotations

from shelfmatch.llm import (
    byte_pairs, exact_dedup, line_dedup, mixing, ngram_scores, piecewise, private_data, quality_model, quality_rules, secrets, simhash,
    turn_repair, whitening,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_model": quality_model.op3_quality_model,
    "op4_byte_bpe": byte_pairs.op4_byte_bpe,
    "op5_private_data": private_data.op5_private_data,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_secrets": secrets.op7_secrets,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_lm_scores": ngram_scores.op10_lm_scores,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_whitening": whitening.op12_whitening,
    "op13_fingerprints": piecewise.op13_fingerprints,
}

ORACLE = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_mixing": mixing.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op10_lm_scores": ngram_scores.SQL,
}
