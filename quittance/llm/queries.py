"""The corpus queries by name, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from quittance.llm import bpe, decontaminate, embedding_dedup, fill_middle, language_id, license_scan, line_dedup, name_join, pii, simhash, token_output, top_k, url_filter

_MODULES = {
    "op1_simhash_dedup": simhash,
    "op2_license_scan": license_scan,
    "op3_url_filter": url_filter,
    "op4_language_id": language_id,
    "op5_bpe_codec": bpe,
    "op6_embedding_dedup": embedding_dedup,
    "op7_pii": pii,
    "op8_line_dedup": line_dedup,
    "op9_token_output": token_output,
    "op10_decontaminate": decontaminate,
    "op11_top_k": top_k,
    "op12_name_join": name_join,
    "op13_fill_middle": fill_middle,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE_SQL for name, m in _MODULES.items() if getattr(m, "ORACLE_SQL", None)}
