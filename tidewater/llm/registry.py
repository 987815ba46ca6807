"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Module and query of each operator, by number.
_WHERE = {
    1: ("packing", "op1_packing"),
    2: ("lines", "op2_line_dedup"),
    3: ("sharding", "op3_sharding"),
    4: ("topk", "op4_exact_topk"),
    5: ("substrings", "op5_substring_dedup"),
    6: ("ngramjoin", "op6_ngram_jaccard"),
    7: ("chat", "op7_chat_format"),
    8: ("decontaminate", "op8_decontamination"),
    9: ("pii", "op9_pii"),
    10: ("langid", "op10_language_id"),
    11: ("structure", "op11_structure_repair"),
    12: ("hardnegatives", "op12_hard_negatives"),
    13: ("superminhash", "op13_superminhash"),
}


def queries() -> dict:
    """Every operator's query by name."""
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for module, name in _WHERE.values()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    found = {name: getattr(importlib.import_module(f".{module}", __package__), "ORACLE", None) for module, name in _WHERE.values()}
    return {name: sql for name, sql in found.items() if sql}
