"""The queries of this package and their SQL twins, by name."""

from __future__ import annotations

from . import (
    conversation_repair,
    exact_dedup,
    jaccard_join,
    language_id,
    license_scan,
    merkle,
    packing,
    periodic_runs,
    piece_tokens,
    quality_trees,
    resampling,
    substring_dedup,
    toxicity,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality_trees": quality_trees.op2_quality_trees,
    "op3_merkle_fingerprints": merkle.op3_merkle_fingerprints,
    "op4_importance_resampling": resampling.op4_importance_resampling,
    "op5_piece_tokens": piece_tokens.op5_piece_tokens,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_language_id": language_id.op10_language_id,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op3_merkle_fingerprints": merkle.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op12_exact_dedup": exact_dedup.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
