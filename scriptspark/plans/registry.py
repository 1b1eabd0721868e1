"""The registered queries of the script and timeline operators, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptspark.plans import dialogue_queries, signal_queries, text_queries, timeline_queries, voice_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (text_queries, dialogue_queries, voice_queries, timeline_queries, signal_queries)


def queries() -> dict[str, Query]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
