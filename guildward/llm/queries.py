"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from guildward.llm import (
    bpe, collocations, conversation_trie, embedding_dedup, html_extract, minhash_dedup, packing, quality_model, quality_rules, secrets_scan, token_files, topk_search,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
        "op4_bpe": bpe.op4_bpe,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_near_duplicates": minhash_dedup.op6_near_duplicates,
        "op7_quality_classifier": quality_model.op7_quality_classifier,
        "op8_secret_scans": secrets_scan.op8_secret_scans,
        "op9_token_files": token_files.op9_token_files,
        "op10_html_extraction": html_extract.op10_html_extraction,
        "op11_collocations": collocations.op11_collocations,
        "op12_conversation_trie": conversation_trie.op12_conversation_trie,
        "op13_topk_search": topk_search.op13_topk_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.OP2_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op12_conversation_trie": conversation_trie.OP12_SQL,
        "op13_topk_search": topk_search.OP13_SQL,
    }
