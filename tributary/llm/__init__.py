"""Operators for training-data pipelines over the tables documents, embeddings and labels.

Nothing outside this subpackage imports it. Each module holds one operator, the query that
applies it with its production parameters, and SQL for the same rows where SQL can say them.
"""

from __future__ import annotations

from importlib import import_module

NAMES = (
    "near_dedup",
    "sentencepiece_lattice",
    "mixing",
    "suffix_dedup",
    "maxent_lm",
    "sharding",
    "vector_search",
    "jpeg_media",
    "license_scan",
    "quality",
    "merkle_manifest",
    "source_divergence",
    "personal_data",
)


def _modules():
    return [import_module(f"tributary.llm.{name}") for name in NAMES]


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in module.ORACLE.items()}
