"""The queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "token_counts", "jaccard", "exact_dedup", "secrets", "bpe", "quality", "toxicity", "language", "fingerprints")
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f".{_name}", __package__)
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
