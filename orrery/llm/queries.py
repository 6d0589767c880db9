"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, hmm, language_id, line_dedup, mixing, outliers, quality, secrets, simhash

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_language_id": language_id.query,
    "op10_hmm_lm_scoring": hmm.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_quality_classifier": quality.query,
    "op5_source_mixing": mixing.query,
    "op6_secret_scan": secrets.query,
    "op7_chat_formatting": chat.query,
    "op8_decontamination": decontaminate.query,
    "op9_quality_rules": outliers.query,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op7_chat_formatting": chat.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
}
