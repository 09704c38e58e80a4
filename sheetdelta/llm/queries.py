"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: module -> queries in it
_MODULES = {
    "op1_secrets": ["op1_secret_ledger", "secret_ledger_history"],
    "op2_near_dup": ["op2_minhash_components"],
    "op3_pii": ["op3_pii_anchors"],
    "op4_bpe": ["op4_bpe_round_trip"],
    "op5_warc": ["op5_warc_revisits"],
    "op6_quality": ["op6_quality_mcd"],
    "op7_packing": ["op7_vector_packing"],
    "op8_language": ["op8_cross_parsing"],
    "op9_substring": ["op9_repeated_units"],
    "op10_vectors": ["op10_posting_lists"],
    "op11_suffix": ["op11_bucket_pointers"],
    "op12_divergence": ["op12_source_divergence"],
    "op13_resampling": ["op13_target_resampling"],
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for module, names in _MODULES.items() for name in names}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, names in _MODULES.items():
        sql = getattr(importlib.import_module(f".{module}", __package__), "ORACLE_SQL", None)
        if sql:
            found[names[0]] = sql
    found["secret_ledger_history"] = importlib.import_module(".op1_secrets", __package__).HISTORY_SQL
    return found
