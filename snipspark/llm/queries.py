"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, decontaminate, fim, hard_negatives, jaccard_join, langid, near_vectors, pieces, quality, sharding, substrings, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_language_id": langid.op2,
    "op3_substring_dedup": substrings.op3,
    "op4_quality_rules": quality.op4,
    "op5_toxicity": toxicity.op5,
    "op6_chat_formatting": chat.op6,
    "op7_jaccard_join": jaccard_join.op7,
    "op8_sharding": sharding.op8,
    "op9_sentencepiece": pieces.op9,
    "op10_warc": warc.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_fill_in_middle": fim.op12,
    "op13_near_vectors": near_vectors.op13,
}
ORACLE = {
    "op1_decontaminate": decontaminate.ORACLE_OP1,
    "op3_substring_dedup": substrings.ORACLE_OP3,
    "op4_quality_rules": quality.ORACLE_OP4,
    "op6_chat_formatting": chat.ORACLE_OP6,
    "op7_jaccard_join": jaccard_join.ORACLE_OP7,
    "op10_warc": warc.ORACLE_OP10,
    "op11_hard_negatives": hard_negatives.ORACLE_OP11,
    "op12_fill_in_middle": fim.ORACLE_OP12,
    "op13_near_vectors": near_vectors.ORACLE_OP13,
}
