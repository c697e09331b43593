"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from voxtally.llm import chat, edits, exact, fingerprint, langid, lexical, mixing, neardup, packing, quality, repair, token_files, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_language_id": langid.op2_language_id,
    "op3_reply_trees": chat.op3_reply_trees,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_range_coded_tokens": token_files.op5_range_coded_tokens,
    "op6_order_minhash": fingerprint.op6_order_minhash,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_bag_minhash": neardup.op9_bag_minhash,
    "op10_edit_counts": edits.op10_edit_counts,
    "op11_ranked_search": lexical.op11_ranked_search,
    "op12_url_filters": urls.op12_url_filters,
    "op13_structure_repair": repair.op13_structure_repair,
}

ORACLES = {"op3_reply_trees": chat.OP3_SQL, "op4_exact_dedup": exact.OP4_SQL, "op8_source_mixing": mixing.OP8_SQL, "op11_ranked_search": lexical.OP11_SQL, "op13_structure_repair": repair.OP13_SQL}
