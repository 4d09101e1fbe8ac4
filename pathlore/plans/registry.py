"""All queries of the reference's own operators, by name, with their SQL oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds ``f(spark, sf_dir)`` to QUERIES and its DuckDB SQL to ORACLES."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Registers the queries of this library."""
    from pathlore.plans import curation_queries, evidence_queries, history_queries, learning_queries, parser_queries, queries, retrieval_queries, screen_queries, search_queries, source_queries, state_queries, stream_queries  # noqa: F401
