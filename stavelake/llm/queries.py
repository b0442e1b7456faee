"""The queries of this subpackage and their SQL."""

from stavelake.llm import bpe, chat, conversation_repair, decontamination, language_model, line_dedup, near_dedup, quality_classifier, quality_rules, sharding, simhash, url_filter, whitening

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_chat": chat.op3_chat,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_katz_lm": language_model.op8_katz_lm,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_whitening": whitening.op11_whitening,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_simhash": simhash.op13_simhash,
}
ORACLE_SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op3_chat": chat.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
}
