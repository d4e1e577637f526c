"""The corpus queries, one for each operator, and their SQL twins."""

from __future__ import annotations

from plumbline.llm import decontamination, fill_in_middle, filter_audit, licenses, lm_scoring, packing, quality_crf, quality_rules, secrets, simhash, source_mixing, substring, token_counts


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_packing": packing.op2_packing,
        "op3_substring_dedup": substring.op3_substring_dedup,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_lm_scoring": lm_scoring.op5_lm_scoring,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_quality_classifier": quality_crf.op9_quality_classifier,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_source_mixing": source_mixing.op12_source_mixing,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": quality_rules.ORACLE,
        "op7_decontamination": decontamination.ORACLE,
        "op11_fill_in_middle": fill_in_middle.ORACLE,
        "op13_filter_audit": filter_audit.ORACLE,
    }
