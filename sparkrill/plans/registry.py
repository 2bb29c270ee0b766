"""The queries of the core and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkrill.plans import corpus, evaluation, events, incremental, ingest, models, summaries, texts, vectors

_ALL = {**events.QUERIES, **models.QUERIES, **corpus.QUERIES, **texts.QUERIES, **vectors.QUERIES, **evaluation.QUERIES, **incremental.QUERIES, **ingest.QUERIES, **summaries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
