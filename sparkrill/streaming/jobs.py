"""Micro-batch jobs over file streams: upserts, windowed counts with a watermark, sessions, online spikes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sparkrill.operators.upsert import Snapshots
from sparkrill.storage import names_in, new_folder


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a table that is a file or a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}.parquet") if fs.getFileStatus(path).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregation over all that is there and gives its last result as a table in the shared folder."""
    spark, out = stream.sparkSession, new_folder(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that runs again overwrites its own folder only.
        batch.write.mode("overwrite").parquet(f"{out}/b{batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", new_folder(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema
    # The folders tell which batches there were: the query remembers only its last ones.
    batches = sorted(int(name[1:]) for name in names_in(spark, out))
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out}/b{k}" for k in (batches[-1:] if mode == "complete" else batches)])


def upsert_stream(stream: DataFrame, target: Snapshots, key: list[str], updated: list[str], required: list[str], order: str, checkpoint: str) -> None:
    """Upserts a stream of rows micro-batch by micro-batch; at-least-once delivery is made idempotent by the key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        target.upsert(batch, key, updated, required, F.col(order))

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_counts(events: DataFrame, time: str, entity: str, late: str = "2 days") -> DataFrame:
    """(entity, day, n): tumbling days with a watermark for late rows."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", "1 day").alias("w"), F.col(entity).alias("entity")).agg(F.count("*").alias("n")).select("entity", F.to_date("w.start").alias("day"), "n")


def sliding_counts(events: DataFrame, time: str, entity: str, late: str = "2 days") -> DataFrame:
    """(entity, until, n): seven-day windows that move by a day."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", "7 days", "1 day").alias("w"), F.col(entity).alias("entity")).agg(F.count("*").alias("n")).select("entity", F.to_date("w.end").alias("until"), "n")


def sessions(events: DataFrame, time: str, entity: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(entity, started, ended, n): runs of events with no longer pause than the gap."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.session_window("_t", gap).alias("w"), F.col(entity).alias("entity")).agg(F.count("*").alias("n")).select("entity", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def online_spikes(days: DataFrame, window: int = 14, min_baseline: int = 5, min_count: int = 5, threshold: float = 3.5) -> DataFrame:
    """(entity, day, n, z) of a stream (entity, day, n) in day order: each entity keeps its last days as state, gaps count 0."""
    import numpy as np
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        found = []
        for day, n in sorted((d.toordinal(), int(c)) for frame in frames for d, c in zip(frame["day"], frame["n"])):
            if last is not None:
                past += [0] * min(max(day - last - 1, 0), window)
            base = np.array(past[-window:], float)
            if len(base) >= min_baseline and n >= min_count:
                median = float(np.median(base))
                z = 0.6745 * (n - median) / max(float(np.median(np.abs(base - median))), 1.0)
                if z >= threshold and n > median:
                    found.append((key[0], pd.Timestamp.fromordinal(day).date(), n, z))
            past, last = [*past, n][-window:], day
        state.update((past, last))
        yield pd.DataFrame(found, columns=["entity", "day", "n", "z"])

    return days.groupBy("entity").applyInPandasWithState(step, "entity string, day date, n bigint, z double", "past array<int>, last int", "append", GroupStateTimeout.NoTimeout)


def start_once(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a job under a name, unless it still runs: then its running query is given."""
    for query in stream.sparkSession.streams.active:
        if query.name == name:
            return query
    return stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished_within(query: StreamingQuery, seconds: int) -> bool:
    """Waits for a job; one that takes longer is stopped and goes on from its checkpoint when it is started again."""
    done = query.awaitTermination(seconds)
    if not done:
        query.stop()
    return bool(done)


def chained(spark: SparkSession, folder: str, schema: str, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], timeout: int = 3600) -> list[str]:
    """Runs jobs that wait for each other's data: each step reads as a stream what the step before wrote since its last run, and writes
    its own result under its name. Without new data nothing runs. Returns the names of the steps that had data.

    folder/landed holds the first step's Parquet input. Results of a batch that runs again replace that batch's own folder.
    """
    ran, source = [], "landed"
    for name, step in steps:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{source}")
        before = names_in(spark, f"{folder}/{name}")

        def write(batch: DataFrame, batch_id: int, out: str = f"{folder}/{name}", step: Callable[[DataFrame], DataFrame] = step) -> None:
            step(batch).write.mode("overwrite").parquet(f"{out}/b{batch_id:06d}")

        if not finished_within(start_once(stream, f"{folder}:{name}", write, f"{folder}/state-{name}"), timeout):
            raise TimeoutError(name)
        after = names_in(spark, f"{folder}/{name}")
        if after != before:
            ran.append(name)
        if not after:
            break
        schema, source = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/{name}").schema, name
    return ran
