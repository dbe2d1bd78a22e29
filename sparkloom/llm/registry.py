"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat_format, chosen_path, chunk_dedup, decontaminate, filter_audit, license_scan, ngram_join, ngram_lm, packing, pii, quality_rules, shuffle_shards, structure_repair

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_shuffle_shards": shuffle_shards.op2_shuffle_shards,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_packing": packing.op4_packing,
    "op5_pii": pii.op5_pii,
    "op6_chunk_dedup": chunk_dedup.op6_chunk_dedup,
    "op7_ngram_lm": ngram_lm.op7_ngram_lm,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_structure_repair": structure_repair.op11_structure_repair,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_chosen_path": chosen_path.op13_chosen_path,
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op9_ngram_join": ngram_join.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "op11_structure_repair": structure_repair.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_chosen_path": chosen_path.ORACLE_SQL,
}
