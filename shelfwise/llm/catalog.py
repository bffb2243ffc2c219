"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from shelfwise.llm import (collisions, count_viterbi, dim_lloyd, language_cnn, level_dedup, line_blocks, mixing, packing,
                           pii, quality_rules, quotations, setsketch, turn_repair)

QUERIES = {
    "op1_main_text": line_blocks.op1_main_text,
    "op2_quotations": quotations.op2_quotations,
    "op3_substring_dedup": level_dedup.op3_substring_dedup,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_counts": count_viterbi.op7_token_counts,
    "op8_embedding_dedup": collisions.op8_embedding_dedup,
    "op9_near_dedup": setsketch.op9_near_dedup,
    "op10_language": language_cnn.op10_language,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_personal_data": pii.op12_personal_data,
    "op13_centroids": dim_lloyd.op13_centroids,
}

SQL = {**quality_rules.ORACLE_SQL, **level_dedup.ORACLE_SQL, **collisions.ORACLE_SQL, **setsketch.ORACLE_SQL,
       **dim_lloyd.ORACLE_SQL}
