"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from cuelake.llm import (
    chat_format, conversation_repair, decontaminate, hmm_lm, language_id, license_scan, line_dedup, merkle, mixing, quality_fm, quality_rules, simhash_dedup, warc,
)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality_fm": quality_fm.op3_quality_fm,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_simhash_dedup": simhash_dedup.op8_simhash_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_hmm_lm": hmm_lm.op10_hmm_lm,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_warc": warc.op12_warc,
    "op13_merkle": merkle.op13_merkle,
}
#: None where SQL cannot express the query; tests/llm then holds it against a brute-force version.
ORACLE_SQL = {
    "op4_mixing": mixing.OP4_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
