"""Collects the queries and SQL of the operators' modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("url_filter", "near_dedup", "line_frequency", "embedding_dedup", "mixing", "toxicity", "token_files", "pieces", "licenses", "pii", "merkle", "decontamination", "whitening")


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"monthmill.llm.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
