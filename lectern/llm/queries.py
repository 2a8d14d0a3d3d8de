"""The queries of this subpackage: name -> function of (spark, sf_dir), and the SQL for those that SQL can express."""

from __future__ import annotations

from lectern.llm import archive, conversations, decontamination, fingerprint, hard_negatives, licenses, lm_scoring, mixing, near_dedup, sharding, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_decontamination": decontamination.op1,
    "op2_lm_scoring": lm_scoring.op2,
    "op3_arc_to_warc": archive.op3,
    "op4_toxicity": toxicity.op4,
    "op5_sharding": sharding.op5,
    "op6_url_filter": url_filter.op6,
    "op7_mixing": mixing.op7,
    "op8_fingerprint": fingerprint.op8,
    "op9_near_dedup": near_dedup.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_conversation_repair": conversations.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_license_scan": licenses.op13,
}
ORACLES = {
    "op3_arc_to_warc": archive.OP3_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_license_scan": licenses.OP13_SQL,
}
