"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "exact_dedup", "simhash", "pii", "quality_model", "chat", "bpe", "quality_rules", "sharding", "token_files", "merkle", "collocations", "sketches")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"landfold.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"landfold.llm.{m}").ORACLE_SQL.items()}
