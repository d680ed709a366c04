"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import importlib

from tallyloom.llm.registry import LLM_QUERIES

MODULES = [
    "url_filter", "byte_bpe", "line_templates", "html_cut", "masked_lm", "quality_rules", "toxicity", "packing", "neighbours", "simhash",
    "conversation_trie", "language_id", "conversation_repair",
]

for _m in MODULES:
    importlib.import_module(f"tallyloom.llm.{_m}")

__all__ = ["LLM_QUERIES"]
