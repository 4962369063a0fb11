"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from groundtrack.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, personal_data, phrases, quality, secrets, source_mix, suffix_dedup, topk, vector_codes

QUERIES = {
    "op1_quality": quality.query,
    "op2_source_mix": source_mix.query,
    "op3_personal_data": personal_data.query,
    "op4_line_dedup": line_dedup.query,
    "op5_topk": topk.query,
    "op6_secrets": secrets.query,
    "op7_decontaminate": decontaminate.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_language_id": language_id.query,
    "op11_packing": packing.query,
    "op12_vector_codes": vector_codes.query,
    "op13_phrases": phrases.query,
}

SQL = {
    "op5_topk": topk.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_phrases": phrases.SQL,
}
