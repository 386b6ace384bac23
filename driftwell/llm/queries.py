"""The queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from . import best_fit_packing, exact_dedup, fingerprint, language_id, line_dedup, minhash, quality, sentencepiece_codec, sharding, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_best_fit_packing": best_fit_packing.op3_best_fit_packing,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_document_fingerprints": fingerprint.op6_document_fingerprints,
    "op7_hilbert_sharding": sharding.op7_hilbert_sharding,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
SQL = {"op10_exact_dedup": exact_dedup.SQL}
