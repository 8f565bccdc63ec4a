"""The queries of this folder, by name, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from terravane.llm import (
    alignment,
    chat,
    decontaminate,
    licenses,
    manifest,
    mixing,
    nearest,
    packing,
    quality,
    simhash,
    tokencounts,
    topk,
    toxicity,
)

QUERIES = {
    "op1_source_mix": mixing.query,
    "op2_license_scan": licenses.query,
    "op3_best_fit_packing": packing.query,
    "op4_simhash_components": simhash.query,
    "op5_preference_format": chat.query,
    "op6_toxicity": toxicity.query,
    "op7_exact_top_k": topk.query,
    "op8_token_counts": tokencounts.query,
    "op9_nearest_neighbours": nearest.query,
    "op10_quality_grades": quality.query,
    "op11_tokenizer_alignment": alignment.query,
    "op12_decontamination": decontaminate.query,
    "op13_merkle_manifest": manifest.query,
}

SQL = {
    "op1_source_mix": mixing.SQL,
    "op2_license_scan": licenses.SQL,
    "op5_preference_format": chat.SQL,
    "op7_exact_top_k": topk.SQL,
    "op12_decontamination": decontaminate.SQL,
    "op13_merkle_manifest": manifest.SQL,
}
