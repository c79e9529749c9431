"""The registered queries of this subpackage."""

from tesserae.llm import op1_bpe, op2_license, op3_secrets, op4_quality, op5_decontam, op6_simhash, op7_lines, op8_tokens, op9_language, op10_substring, op11_phrases, op12_fingerprints, op13_audit

_MODULES = {
    "op1_bpe": op1_bpe,
    "op2_license_scan": op2_license,
    "op3_secret_scan": op3_secrets,
    "op4_quality_rules": op4_quality,
    "op5_decontamination": op5_decontam,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_lines,
    "op8_token_output": op8_tokens,
    "op9_language_id": op9_language,
    "op10_substring_dedup": op10_substring,
    "op11_phrases": op11_phrases,
    "op12_fingerprints": op12_fingerprints,
    "op13_filter_audit": op13_audit,
}
QUERIES = {name: module.query for name, module in _MODULES.items()}
SQL = {name: module.SQL for name, module in _MODULES.items() if module.SQL}
