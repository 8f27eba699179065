"""The queries of all operators and their SQL, by name."""

from __future__ import annotations

import importlib

_MODULES = ("decontamination", "near_dedup", "token_counts", "lm_scoring", "byte_bpe", "toxicity", "language_id", "line_dedup", "ann", "chat_format", "exact_dedup", "lexical_search", "prefix_trie")

_loaded = [importlib.import_module(f"cohortflow.llm.{m}") for m in _MODULES]
QUERIES = {name: f for m in _loaded for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _loaded for name, sql in m.ORACLES.items()}
