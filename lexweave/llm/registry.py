"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexweave.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

QUERIES = {
    "op1_quality_classifier": op1.op1_quality_classifier,
    "op2_token_counts": op2.op2_token_counts,
    "op3_bpe_codec": op3.op3_bpe_codec,
    "op4_quality_rules": op4.op4_quality_rules,
    "op5_toxicity": op5.op5_toxicity,
    "op6_personal_data": op6.op6_personal_data,
    "op7_chat_format": op7.op7_chat_format,
    "op8_html_text": op8.op8_html_text,
    "op9_decontamination": op9.op9_decontamination,
    "op10_ngram_jaccard_join": op10.op10_ngram_jaccard_join,
}

ORACLE_SQL = {
    "op4_quality_rules": op4.SQL,
    "op7_chat_format": op7.SQL,
    "op9_decontamination": op9.SQL,
    "op10_ngram_jaccard_join": op10.SQL,
}
