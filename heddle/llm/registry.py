"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from heddle.llm import byte_bpe, chat_format, line_dedup, mixing, ngram_join, quality_rules, ranked_search, secret_scan, spelling, substring_dedup, suffix_dedup, topk_search, url_filter

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_topk_search": topk_search.op10_topk_search,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {
    "op2_chat_format": chat_format.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op9_ngram_join": ngram_join.OP9_SQL,
    "op10_topk_search": topk_search.OP10_SQL,
    "op11_suffix_dedup": suffix_dedup.OP11_SQL,
    "op12_ranked_search": ranked_search.OP12_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
