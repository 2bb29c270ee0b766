"""Ranks and running sums over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrill.storage import written


def globally_ranked(rows: DataFrame, order: list[Column], sums: list[str] = [], rank: str = "rank") -> DataFrame:  # noqa: B006
    """rows with a 1-based rank in the order, and for each column of sums its running total up to the row as cum_<column>.

    The order should be total. Rows are range-partitioned and ranked within partitions; the partitions' totals, one row
    each, give the offsets.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = W.partitionBy().orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums])
    inside = W.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn(rank, (F.row_number().over(inside) + F.col("_n")).cast("bigint"))
    for c in sums:
        ranked = ranked.withColumn(f"cum_{c}", F.sum(c).over(upto) + F.col(f"_s_{c}"))
    return ranked.drop("_part", "_n", *[f"_s_{c}" for c in sums])
