"""The corpus queries and their DuckDB counterparts, by registered name."""

from __future__ import annotations

from . import (
    byte_bpe, decontaminate, divergence, jaccard_join, language_id, license_scan, line_dedup, quality, sharding, spelling, token_counts, token_files, url_filter,
)

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_jaccard_join": jaccard_join.query,
    "op3_token_counts": token_counts.query,
    "op4_license_scan": license_scan.query,
    "op5_line_dedup": line_dedup.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_quality_rules": quality.query,
    "op8_language_id": language_id.query,
    "op9_url_filter": url_filter.query,
    "op10_decontaminate": decontaminate.query,
    "op11_divergence": divergence.query,
    "op12_sharding": sharding.query,
    "op13_spelling": spelling.query,
}

ORACLE_SQL = {
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_sharding": sharding.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
