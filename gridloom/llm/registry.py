"""The queries of this package, and the SQL that states the same results where SQL can."""

from __future__ import annotations

from . import chat, conversations, decontaminate, language, near_dup, packing, quality, sharding, simhash, toxicity, urls, vector_codes, warc

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_url_filters": urls.query,
    "op3_decontamination": decontaminate.query,
    "op4_chat_formatting": chat.query,
    "op5_toxicity": toxicity.query,
    "op6_language_id": language.query,
    "op7_quality_rules": quality.query,
    "op8_near_dup": near_dup.query,
    "op9_warc": warc.query,
    "op10_sharding": sharding.query,
    "op11_vector_codes": vector_codes.query,
    "op12_simhash": simhash.query,
    "op13_conversation_repair": conversations.query,
}
ORACLE_SQL = {
    "op2_url_filters": urls.SQL,
    "op3_decontamination": decontaminate.SQL,
    "op7_quality_rules": quality.SQL,
    "op8_near_dup": near_dup.SQL,
    "op9_warc": warc.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op13_conversation_repair": conversations.SQL,
}
