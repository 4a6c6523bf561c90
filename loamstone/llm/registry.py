"""Queries of the corpus operators and of the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

MODULES = [
    "warc",
    "hash_search",
    "simhash",
    "host_rules",
    "replication",
    "packing",
    "gam",
    "toxicity",
    "window_dedup",
    "suffix_dedup",
]


def _modules():
    return [import_module(f"loamstone.llm.{name}") for name in MODULES]


def queries() -> dict:
    return {m.QUERY: m.query for m in _modules()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE for m in _modules() if m.ORACLE}
