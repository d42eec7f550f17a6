"""The corpus queries and, where SQL can state them, their SQL."""

from threadlake.llm import contamination, divergence, exact, langid, lm, manifest, mixing, neardup, pii, quality, sharding, substring, toxicity

QUERIES = {
    "op1_benchmark_decontamination": contamination.op1_benchmark_decontamination,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_pii": pii.op5_pii,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_language_id": langid.op7_language_id,
    "op8_mixing": mixing.op8_mixing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_sharding": sharding.op11_sharding,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL = {
    "op1_benchmark_decontamination": contamination.SQL,
    "op2_exact_dedup": exact.SQL,
    "op10_substring_dedup": substring.SQL,
    "op11_sharding": sharding.SQL,
    "op12_merkle_manifest": manifest.SQL,
    "op13_source_divergence": divergence.SQL,
}
