"""The queries of this package, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from . import decontam, jaccard, langid, lines, packing, quality, rules, secrets, tokens, urls


def queries() -> dict:
    found = (lines.op1_line_dedup, quality.op2_quality_mil, tokens.op3_token_rans, rules.op4_quality_rules, urls.op5_url_filter, langid.op6_language_id, secrets.op7_secret_scan, decontam.op8_decontamination, packing.op9_best_fit, jaccard.op10_ngram_jaccard)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": lines.ORACLE_SQL, "op5_url_filter": urls.ORACLE_SQL, "op8_decontamination": decontam.ORACLE_SQL}
