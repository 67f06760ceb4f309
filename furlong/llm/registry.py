"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from furlong.llm import decontamination, embeddings, importance, language, mixing, quality, repeats, secrets, sharding, simhash, topk, warc, whitening

QUERIES = {
    "op1_prefix_decontamination": decontamination.q_decontamination,
    "op2_virtual_slot_sharding": sharding.q_sharding,
    "op3_pu_quality": quality.q_quality,
    "op4_warc_capture_index": warc.q_warc,
    "op5_ppm_language": language.q_language,
    "op6_simhash_vantage_trees": simhash.q_simhash,
    "op7_repeat_intervals": repeats.q_repeats,
    "op8_quantised_embeddings": embeddings.q_embeddings,
    "op9_low_discrepancy_mixing": mixing.q_mixing,
    "op10_secret_battery": secrets.q_secrets,
    "op11_pivot_top_k": topk.q_topk,
    "op12_chebyshev_whitening": whitening.q_whitening,
    "op13_importance_resampling": importance.q_importance,
}
ORACLE = {
    "op1_prefix_decontamination": decontamination.ORACLE_DECONTAMINATION,
    "op4_warc_capture_index": warc.ORACLE_WARC,
    "op7_repeat_intervals": repeats.ORACLE_REPEATS,
    "op8_quantised_embeddings": embeddings.ORACLE_EMBEDDINGS,
    "op9_low_discrepancy_mixing": mixing.ORACLE_MIXING,
    "op11_pivot_top_k": topk.ORACLE_TOPK,
    "op13_importance_resampling": importance.ORACLE_IMPORTANCE,
}
