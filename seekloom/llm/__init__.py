"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

The modules are imported when they are asked for, so a Python worker loads only what its function needs.
"""

from __future__ import annotations

from importlib import import_module

_MODULES = ("decontaminate", "shards", "toxicity", "warc", "privacy", "bpe", "language", "spots", "html", "neardup")


def _found(name: str) -> dict:
    return {k: v for module in _MODULES for k, v in getattr(import_module(f"{__name__}.{module}"), name).items()}


def queries() -> dict:
    return _found("QUERIES")


def oracle_sql() -> dict:
    return _found("SQL")
