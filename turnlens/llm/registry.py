"""Registry of this subpackage: ``key -> (spark, sf_dir) -> DataFrame`` and ``key -> DuckDB SQL``."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(key: str, sql: str | None = None):
    """Register a query under ``key``; ``sql`` is DuckDB SQL over the given tables."""
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco
