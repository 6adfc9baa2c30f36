"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this package whose ``query`` (and ``ORACLE_SQL``, where SQL can say it) it is
MODULES = {
    "op6_mincut": "mincut",
    "op3_mixing": "mixing",
    "op8_toxicity": "toxicity",
    "op4_repeats": "repeats",
    "op9_pieces": "pieces",
    "op1_language_id": "langid",
    "op7_hnsw": "hnsw",
    "op2_token_files": "token_files",
    "op5_decontaminate": "decontaminate",
    "op10_simhash": "simhash",
}


def queries() -> dict:
    return {name: import_module(f"tessera.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tessera.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
