"""All queries of the panel engine and their SQL."""

from __future__ import annotations

from . import explore, forecast, prepare, serve  # noqa: F401  (they register their queries)
from .base import REGISTRY


def queries() -> dict:
    return {n: q.run for n, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {n: sql for n, q in REGISTRY.items() if (sql := q.oracle())}
