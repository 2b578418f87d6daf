"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "j2_hybrid_search"


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from . import chunk_queries, conversation_queries, episode_queries, evaluation_queries, extraction_queries, intent_queries, knowledge_queries, probe_queries, rank_queries, recall_queries, retry_queries, search_queries, stream_queries  # noqa: E402, F401
