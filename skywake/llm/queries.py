"""Queries of this subpackage and, where SQL can express them, the DuckDB SQL they are checked against."""

from __future__ import annotations

from skywake.llm import bpe, chat, gridjoin, language, lines, neardup, packing, periods, quality, suffixes, topk, toxicity, whitening

QUERIES = {
    "op1_top_k": topk.op1_top_k,
    "op2_chat_format": chat.op2_chat_format,
    "op3_minhash": neardup.op3_minhash,
    "op4_packing": packing.op4_packing,
    "op5_embedding_dedup": gridjoin.op5_embedding_dedup,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_quality": quality.op8_quality,
    "op9_language_id": language.op9_language_id,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_periodic_runs": periods.op13_periodic_runs,
}

#: The others have no form in SQL that ends on whole tables, or none at all; tests/llm checks them against brute force.
ORACLES: dict[str, str] = {
    "op1_top_k": topk.OP1_SQL,
    "op5_embedding_dedup": gridjoin.OP5_SQL,
    "op7_line_dedup": lines.OP7_SQL,
}
