"""Named queries of the text operators and their oracle SQL."""

from __future__ import annotations

from signaldeck.llm import decontamination, jaccard_join, license_scan, line_dedup, quality_rules, substring_dedup, vector_codes
from signaldeck.llm.html_extraction import op9_html_extraction
from signaldeck.llm.packing import op1_packing
from signaldeck.llm.quality_classifier import op3_quality_classifier
from signaldeck.llm.token_alignment import op12_token_alignment
from signaldeck.llm.token_counts import op5_token_counts
from signaldeck.llm.token_files import op6_token_files

QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_token_files": op6_token_files,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_license_scan": license_scan.op13_license_scan,
}
ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op4_jaccard_join": jaccard_join.ORACLE_SQL,
    "op7_decontamination": decontamination.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op13_license_scan": license_scan.ORACLE_SQL,
}
