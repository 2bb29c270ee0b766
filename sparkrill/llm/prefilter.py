"""A filter of bounded size that tells rows whose id may be wanted from the others before a join shuffles them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 16, 1 << 26  # slots; the most are 8 megabytes of bits


def slots_for(n: int) -> int:
    """Slots for n ids: 16 for each, a power of two within LEAST and MOST. Beyond that more rows pass, and none is lost."""
    return min(max(1 << (16 * max(n, 1) - 1).bit_length(), LEAST), MOST)


def marked(slots: DataFrame, size: int) -> bytes:
    """The bits of the slots (one integer column) that occur, packed. Each task sends a bitmap of those it saw, so that the driver holds one bitmap at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    packed = np.zeros(size // 8, np.uint8)
    for row in slots.mapInArrow(run, "bits binary").toLocalIterator():
        packed |= np.frombuffer(row.bits, np.uint8)
    return packed.tobytes()


def likely(rows: DataFrame, wanted: DataFrame, column: str = "id", split: bool = False) -> DataFrame:
    """The rows whose id may be in wanted (one column, named alike): no wanted row is lost, some others stay. With split, all rows and a boolean _may."""
    size = slots_for(wanted.count())
    slot = F.pmod(F.xxhash64(column), F.lit(size)).cast("int").alias("slot")
    packed = marked(wanted.select(slot).repartition(8), size)
    kept = rows.schema.fields
    schema = rows.select("*", F.lit(True).alias("_may")).schema if split else rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            hit = pa.array(bits[batch.column(len(kept)).to_numpy()])
            columns = [batch.column(k) for k in range(len(kept))]
            if split:
                yield pa.RecordBatch.from_arrays([*columns, hit], [*[f.name for f in kept], "_may"])
            else:
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept]).filter(hit)

    return rows.select("*", slot).mapInArrow(run, schema)
