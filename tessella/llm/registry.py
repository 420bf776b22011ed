"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import jaccard_join, languages, media, mixing, packing, page_differencing, quality_mil, quality_rules, quotations, target_resampling, token_store, toxicity, vector_codes

QUERIES = {
    "op1_token_shards": token_store.op1_token_shards,
    "op2_media_columns": media.op2_media_columns,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_language_id": languages.op4_language_id,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_quotation_linking": quotations.op7_quotation_linking,
    "quoted_threads": quotations.quoted_threads,
    "op8_quality_attention": quality_mil.op8_quality_attention,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_packing": packing.op10_packing,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_target_resampling": target_resampling.op12_target_resampling,
    "op13_page_text": page_differencing.op13_page_text,
}
ORACLES: dict[str, str] = {
    "op3_jaccard_join": jaccard_join.ORACLE_SQL,
    "op5_mixing": mixing.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "quoted_threads": quotations.THREADS_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_target_resampling": target_resampling.ORACLE_SQL,
    "op13_page_text": page_differencing.ORACLE_SQL,
}
