"""Walking a source's pages into the landing folder: what to fetch, when to stop and what to try again. The fetching itself is injected.

A fetcher takes a term and a page number and gives that page's raw records. A walk keeps the records of a half-open window
of time, each id once, and stops after a page that is short, or that is older than the window throughout.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

Fetch = Callable[[str, int], list[dict]]


class Retryable(Exception):
    """What may pass if tried again: a timeout, an overload, an error of the server."""


def retried(call: Callable[[], list[dict]], tries: int = 4, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """The call's result; after a Retryable error it is made again, with twice the wait each time, until the last error goes up."""
    for k in range(tries):
        try:
            return call()
        except Retryable:
            if k + 1 == tries:
                raise
            sleep(first_wait * 2**k)
    return []


def walk(fetch: Fetch, term: str, key: str, at: Callable[[dict], float | None], since: float | None = None, until: float | None = None, page_size: int = 50, max_pages: int = 10, seen: set[str] | None = None) -> Iterator[dict]:
    """The records of a term with since <= time < until and an id not in seen; records without a time are kept, without an id left out."""
    seen = set() if seen is None else seen
    for page in range(max_pages):
        records = retried(lambda page=page: fetch(term, page))
        times = [at(r) for r in records]
        for record, moment in zip(records, times):
            name = record.get(key)
            if name is None or str(name) in seen or moment is not None and (since is not None and moment < since or until is not None and moment >= until):
                continue
            seen.add(str(name))
            yield record
        old = since is not None and bool(records) and all(t is not None and t < since for t in times)
        if len(records) < page_size or old:
            return


def crawled(fetch: Fetch, terms: Iterable[str], key: str, at: Callable[[dict], float | None], failed: Callable[[str, Exception], None] | None = None, **options: float) -> Iterator[dict]:
    """The records of all terms, each id once. A term that fails does not stop the others: it is told to `failed`."""
    seen: set[str] = set()
    for term in terms:
        try:
            yield from walk(fetch, term, key, at, seen=seen, **options)
        except Exception as error:  # noqa: BLE001
            if failed:
                failed(term, error)


def land(spark: SparkSession, records: Iterable[dict], path: str, chunk: int = 10_000) -> int:
    """Appends raw records as JSON lines to the landing folder, a chunk at a time, and returns their number."""
    total, kept = 0, []

    def write() -> None:
        spark.createDataFrame([(line,) for line in kept], "value string").coalesce(1).write.mode("append").text(path)

    for record in records:
        kept.append(json.dumps(record, ensure_ascii=False))
        total += 1
        if len(kept) == chunk:
            write()
            kept.clear()
    if kept:
        write()
    return total


def strict(rows: DataFrame, required: list[str], what: str = "record") -> DataFrame:
    """rows, or an error in the job if one lacks a required field."""
    from pyspark.sql import functions as F

    for name in required:
        rows = rows.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"{what} without {name}")).cast(rows.schema[name].dataType)))
    return rows
