"""The training-data queries, and SQL for those that SQL can express."""

from __future__ import annotations

from loomtext.llm import decontam, divergence, fim, langid, lm, near_dups, piece_codec, quality, secrets, substring_dedup, suffix_dedup, syncmers, token_counts

QUERIES = {
    f.__name__: f
    for f in (
        langid.op1_language_id,
        near_dups.op2_minhash_near_dedup,
        decontam.op3_benchmark_decontamination,
        piece_codec.op4_piece_codec,
        token_counts.op5_token_counts,
        secrets.op6_secret_scan,
        suffix_dedup.op7_suffix_array_dedup,
        lm.op8_lm_scoring,
        substring_dedup.op9_substring_dedup,
        quality.op10_quality_rules,
        divergence.op11_source_divergence,
        fim.op12_fill_in_middle,
        syncmers.op13_syncmer_fingerprints,
    )
}
ORACLES: dict[str, str] = {"op10_quality_rules": quality.OP10_SQL, "op11_source_divergence": divergence.OP11_SQL, "op12_fill_in_middle": fim.OP12_SQL}
