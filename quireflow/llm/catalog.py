"""All queries of this package."""

from __future__ import annotations

import importlib

_MODULES = ("term", "split", "near", "markup", "encode", "pack", "span")

QUERIES: dict = {}
SQL: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"quireflow.llm.{_name}_queries")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
