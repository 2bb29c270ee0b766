"""Where the vocabulary files of the public tokenizers lie; the folder is a parameter, the files are never copied."""

from __future__ import annotations

import os

from pyspark import SparkContext, SparkFiles
from pyspark.sql import SparkSession

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def ship(spark: SparkSession, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> None:
    """Gives the driver's vocabulary file, a few megabytes, to the executors: they need not hold the folder."""
    spark.sparkContext.addFile(f"{folder}/{name}")


def ranks_of(folder: str = TOKENIZERS, name: str = BYTE_BPE) -> dict[bytes, int]:
    """Token bytes to rank, from the shipped file or else the folder."""
    import base64

    # Without a session there are no shipped files.
    shipped = SparkFiles.get(name) if SparkContext._active_spark_context or SparkFiles._is_running_on_worker else ""
    with open(shipped if os.path.exists(shipped) else f"{folder}/{name}", "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
