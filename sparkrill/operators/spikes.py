"""Robust spikes in daily counts: modified z-score of each day against the trailing days before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, MIN_BASELINE, MIN_COUNT, THRESHOLD, CAP = 14, 5, 5, 3.5, 10.0
MAD_FLOOR = 1.0


def gap_filled(counts: DataFrame, entity: str, day: str = "day", n: str = "n") -> DataFrame:
    """(entity, day, n) with a row for each day from the entity's first to its last; missing days count 0."""
    spans = counts.groupBy(entity).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    spine = spans.select(entity, F.explode(F.expr("sequence(_a, _b, INTERVAL 1 DAY)")).alias(day))
    return spine.join(counts, [entity, day], "left").select(entity, day, F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))


def _median(sorted_values: Column) -> Column:
    size = F.size(sorted_values)
    low, high = F.get(sorted_values, F.floor((size - 1) / 2).cast("int")), F.get(sorted_values, F.floor(size / 2).cast("int"))
    return (low + high) / 2


def modified_z(series: DataFrame, entity: str, day: str = "day", window: int = WINDOW) -> DataFrame:
    """series (entity, day, n) with n_base, median, mad and z of the `window` rows before each day. A frame holds at most that many values."""
    frame = W.partitionBy(entity).orderBy(day).rowsBetween(-window, -1)
    rows = series.withColumn("_base", F.array_sort(F.collect_list(F.col("n").cast("double")).over(frame)))
    rows = rows.withColumn("n_base", F.size("_base")).withColumn("median", _median(F.col("_base")))
    rows = rows.withColumn("mad", _median(F.array_sort(F.transform("_base", lambda x: F.abs(x - F.col("median"))))))
    return rows.withColumn("z", 0.6745 * (F.col("n") - F.col("median")) / F.greatest(F.col("mad"), F.lit(MAD_FLOOR))).drop("_base")


def spikes(counts: DataFrame, entity: str, day: str = "day", n: str = "n", window: int = WINDOW, min_baseline: int = MIN_BASELINE, min_count: int = MIN_COUNT, threshold: float = THRESHOLD) -> DataFrame:
    """(entity, day, n, modified_z, severity, median) of the days that stand out; z and severity have two decimals."""
    if window < min_baseline:
        raise ValueError("window must hold min_baseline days")
    scored = modified_z(gap_filled(counts, entity, day, n), entity, day, window)
    hit = (F.col("n_base") >= min_baseline) & (F.col("n") >= min_count) & (F.col("z") >= threshold) & (F.col("n") > F.col("median"))
    return scored.filter(hit).select(entity, day, "n", F.bround("z", 2).alias("modified_z"), F.bround(F.least(F.col("z"), F.lit(CAP)), 2).alias("severity"), "median")
