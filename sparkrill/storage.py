"""Tables written between stages, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_MADE: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sparkrill-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for this session's own tables: it is deleted by drop_written, at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(drop_written, spark)
    _MADE.append(path)
    return path


def drop_written(spark: SparkSession) -> None:
    """Deletes all folders made so far: results must have been saved or collected."""
    while _MADE:
        try:
            drop_folder(spark, _MADE.pop())
        except Exception:  # noqa: BLE001 - the session is gone, or the folder is someone else's now
            continue


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: they go when the write ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of an executor."""
    path = new_folder(df.sparkSession, name)
    with no_shuffles_left(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_in_rounds(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all parts as one table: what a part shuffles is gone before the next one runs."""
    path = ""
    for part in parts:
        path = path or new_folder(part.sparkSession, name)
        with no_shuffles_left(part.sparkSession):
            part.write.mode("append").parquet(path)
    return part.sparkSession.read.schema(part.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Deletes a table that written() gave: nothing that reads it may run later."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        drop_folder(table.sparkSession, folder)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its few large row groups would leave most of them idle in a step that costs much for each row. A larger input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _filesystem(spark: SparkSession, path: str) -> tuple[object, object]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and host of its file system, so that readers outside Spark find the same place."""
    filesystem, target = _filesystem(spark, path)
    return filesystem.makeQualified(target).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder; one that isn't there is no error."""
    filesystem, target = _filesystem(spark, path)
    filesystem.delete(target, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, sorted; none if there is no such folder."""
    filesystem, target = _filesystem(spark, path)
    return sorted(f.getPath().getName() for f in filesystem.listStatus(target)) if filesystem.exists(target) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a new small file in one step: under another name first, then renamed. An existing file stays and is an error."""
    filesystem, target = _filesystem(spark, path)
    draft = target.suffix(f".{uuid.uuid4().hex[:8]}")
    out = filesystem.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if filesystem.exists(target) or not filesystem.rename(draft, target):
        filesystem.delete(draft, False)
        raise FileExistsError(path)


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
