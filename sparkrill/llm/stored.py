"""Reading single rows of written Parquet tables from within tasks, and groups of sorted rows.

The folder is the shared one, by path or URI (file, hdfs, s3, ...): every executor reads the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrill.llm.shingles import overlap
from sparkrill.storage import written

CALL_BITS, TASK_BITS = 48, 28  # bits of a place below the call, and below the task: places are call, task, row
BLOCK_BITS = 11  # of neighbouring places that are read together
HOT = 4096  # texts that one is held against, from which they are spread
PIECE = 1 << 20  # rows of a piece, but for a group that is larger


def files_in(folder: str, name: str) -> list[str]:
    """The Parquet files in a folder of the store, in order; none if it isn't there."""
    place = f"{folder}/{name}"
    filesystem, path = pafs.FileSystem.from_uri(place if "://" in place or place.startswith("file:") else f"file://{place}")
    scheme = place[: len(place) - len(path)] if place.endswith(path) else ""
    found = filesystem.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(scheme + f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))


def _opened(place: str) -> pq.ParquetFile:
    filesystem, path = pafs.FileSystem.from_uri(place if "://" in place or place.startswith("file:") else f"file://{place}")
    return pq.ParquetFile(filesystem.open_input_file(path))


class Places:
    """The places of the rows that one task writes, in order; made in the task."""

    def __init__(self, call: int) -> None:
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        if task >= 1 << (CALL_BITS - TASK_BITS):
            raise ValueError("too many tasks for one table: coalesce the input or split it")
        self.next, self.last = (call << CALL_BITS) + (task << TASK_BITS), (call << CALL_BITS) + ((task + 1) << TASK_BITS)

    def take(self, n: int) -> np.ndarray:
        self.next += n
        if self.next > self.last:
            raise ValueError("too many rows in one task: split the input")
        return np.arange(self.next - n, self.next)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then the same for the next."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


class Part:
    """Some files of one table."""

    def __init__(self, files: list[str]) -> None:
        self.files = files
        self.opened: dict[str, pq.ParquetFile] = {}

    def _open(self, file: str) -> pq.ParquetFile:
        if file not in self.opened:
            self.opened[file] = _opened(file)
        return self.opened[file]

    def rows(self, columns: list[str]) -> pa.Table | None:
        tables = [self._open(f).read(columns) for f in self.files]
        return pa.concat_tables(tables) if tables else None

    def table(self, key: str, wanted: np.ndarray, columns: list[str]) -> pa.Table:
        """The rows whose key, an integer, is among the sorted wanted ones: only row groups that may hold one are read."""
        tables = []
        for file in self.files:
            source = self._open(file)
            place = source.schema_arrow.get_field_index(key)
            for g in range(source.metadata.num_row_groups):
                bounds = source.metadata.row_group(g).column(place).statistics
                if bounds is not None and bounds.has_min_max and np.searchsorted(wanted, bounds.min) == np.searchsorted(wanted, bounds.max, "right"):
                    continue
                table = source.read_row_group(g, columns)
                values = table.column(key).to_numpy()
                at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
                tables.append(table.filter(pa.array(wanted[at] == values)))
        return pa.concat_tables(tables) if tables else pa.table({c: pa.array([], pa.int64()) for c in columns})

    def among(self, key: str, wanted: np.ndarray, columns: list[str]) -> tuple[np.ndarray, ...]:
        """The columns (integers) of those rows, sorted by the key."""
        table = self.table(key, wanted, columns)
        order = np.argsort(table.column(key).to_numpy(), kind="stable")
        return tuple(table.column(c).to_numpy()[order] for c in columns)

    def sorted_pieces(self, columns: list[str], key: str) -> Iterator[tuple[list[np.ndarray], bool]]:
        """The columns in pieces of about PIECE rows, from files that are one after the other sorted by key. Rows of one key are
        in one piece, but for a key with more rows than that: its pieces but the last are marked False."""
        kept: list[list[np.ndarray]] = []
        place = columns.index(key)
        for file in self.files:
            source = self._open(file)
            for g in range(source.metadata.num_row_groups):
                table = source.read_row_group(g, columns)
                kept.append([table.column(c).to_numpy() for c in columns])
                if sum(len(k[0]) for k in kept) < PIECE:
                    continue
                joined = [np.concatenate(c) for c in zip(*kept)]
                last = int(np.searchsorted(joined[place], joined[place][-1]))
                if last:
                    yield [c[:last] for c in joined], True
                    kept = [[c[last:] for c in joined]]
                else:
                    yield joined, False
                    kept = []
        if kept and sum(len(k[0]) for k in kept):
            yield [np.concatenate(c) for c in zip(*kept)], True


def whole_groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Sorted rows in tables that no group of equal values of the column (integers) is split over."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        last = int(np.searchsorted(values, values[-1]))
        if last or kept and kept[-1].column(column)[-1].as_py() != values[0]:
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def _read(folder: str, tables: list[str], places: np.ndarray) -> pa.Table:
    """loc, id and bag of the rows at the places, in their order."""
    wanted, back = np.unique(places, return_inverse=True)
    found = []
    for file in np.unique(wanted >> TASK_BITS):
        call, task = int(file) >> (CALL_BITS - TASK_BITS), int(file) & ((1 << (CALL_BITS - TASK_BITS)) - 1)
        stored = Part([f for f in files_in(folder, tables[call]) if f.rsplit("/", 1)[1].startswith(f"part-{task:05d}-")])
        found.append(stored.table("loc", wanted[wanted >> TASK_BITS == file], ["loc", "id", "bag"]))
    table = pa.concat_tables(found)
    locs = table.column("loc").to_numpy()
    order = np.argsort(locs)
    return table.take(pa.array(order[np.searchsorted(locs[order], wanted)][back]))


def with_bags(rows: DataFrame, folder: str, tables: list[str], parts: int) -> DataFrame:
    """rows (loc, other integers) with the id and bag of the text at loc, read where it lies: only row groups with a wanted place. Neighbours meet in a task."""
    kept = [c for c in rows.columns if c != "loc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = _read(folder, tables, batch.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(1 + k) for k in range(len(kept))], texts.column("id").combine_chunks(), texts.column("bag").combine_chunks()], ["loc", *kept, "id", "bag"])

    near = rows.select("loc", *kept).repartition(parts, F.shiftright("loc", BLOCK_BITS)).sortWithinPartitions("loc")
    return near.mapInArrow(run, ", ".join(["loc bigint", *[f"{c} bigint" for c in kept], "id bigint", "bag binary"]))


def alike(pairs: DataFrame, folder: str, tables: list[str], parts: int, similarity: float) -> DataFrame:
    """(x, y, id_x, id_y) of the pairs (x, y) of places whose token-pair sets have at least `similarity` of both in common."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = _read(folder, tables, batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts.column("id").combine_chunks(), texts.column("bag").combine_chunks()], ["x", "y", "id_y", "bag"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = _read(folder, tables, batch.column(0).to_numpy())
                hit = [overlap(x, y) >= similarity for x, y in zip(texts.column("bag").to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts.column("id").combine_chunks(), batch.column(2)], ["x", "y", "id_x", "id_y"]).filter(pa.array(hit, pa.bool_()))

    pairs = written(pairs, "alike-pairs")
    # Neighbouring places meet in a task; a text that very many others are held against is spread by these.
    many = pairs.groupBy("y").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("y", F.lit(64).alias("spread"))
    salted = pairs.join(many, "y", "left").withColumn("salt", F.pmod(F.xxhash64("x"), F.coalesce("spread", F.lit(1))))
    first = salted.select("x", "y", F.shiftright("y", BLOCK_BITS).alias("block"), "salt").repartition(parts, "block", "salt").sortWithinPartitions("y").select("x", "y")
    second = first.mapInArrow(held, "x bigint, y bigint, id_y bigint, bag binary").repartition(parts, F.shiftright("x", BLOCK_BITS)).sortWithinPartitions("x")
    return second.mapInArrow(own, "x bigint, y bigint, id_x bigint, id_y bigint")
