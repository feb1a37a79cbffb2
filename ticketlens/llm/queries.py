"""The queries of this subpackage: name -> builder, and their DuckDB SQL."""

from __future__ import annotations

from ticketlens.llm import audit, bpe, codes, language, minhash, mixing, passages, quality, rules, simhash, topk, toxicity

QUERIES = {
    "op1_substring_dedup": passages.op1_substring_dedup,
    "op2_topk_search": topk.op2_topk_search,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_language_id": language.op4_language_id,
    "op5_quality": quality.op5_quality,
    "op6_bpe_encoding": bpe.op6_bpe_encoding,
    "op7_token_counts": bpe.op7_token_counts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash": simhash.op10_simhash,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_minhash": minhash.op13_minhash,
}

ORACLE: dict[str, str] = {
    "op2_topk_search": topk.OP2_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op12_vector_codes": codes.OP12_SQL,
    "op13_minhash": minhash.OP13_SQL,
}
