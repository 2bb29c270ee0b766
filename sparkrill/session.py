"""Session defaults shared by tests, the bench and stand-alone use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "sparkrill", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, AQE with skew handling, and Arrow transfer.

    On a cluster the submitter's settings win: only values that are unset there
    get a default here, and no master is forced.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cores),
    }
    builder = SparkSession.builder.appName(app)
    if "MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", os.environ.get("SPARKRILL_DRIVER_MEMORY", "12g"))
    for key, value in defaults.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once for each application."""
    import tempfile
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sparkrill-ship-")) / "sparkrill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
