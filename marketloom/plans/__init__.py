"""Every query of the engine over the supplied tables."""

from __future__ import annotations

from marketloom.plans import registry


def _load() -> None:
    from marketloom.plans import hourly_queries, indicator_queries, payload_queries, report_queries, store_queries, stream_queries, validation_queries  # noqa: F401


def all_queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(registry.ORACLE_SQL)
