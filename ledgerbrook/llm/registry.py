"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from . import chat, decontamination, embedding_dedup, fill_in_middle, near_dedup, packing, prefix_trie, quality_rules, sharding, substring_dedup, token_matrix, toxicity, warc


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_chat_format": chat.op5_chat_format,
        "op6_token_matrix": token_matrix.op6_token_matrix,
        "op7_sharding": sharding.op7_sharding,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_warc": warc.op9_warc,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.ORACLE_SQL,
        "op3_quality_rules": quality_rules.ORACLE_SQL,
        "op4_substring_dedup": substring_dedup.ORACLE_SQL,
        "op5_chat_format": chat.ORACLE_SQL,
        "op8_near_dedup": near_dedup.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
        "op11_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
        "op13_prefix_trie": prefix_trie.ORACLE_SQL,
    }
