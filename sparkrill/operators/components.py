"""Connected components by large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrill.storage import drop_table, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of edges; component is its smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest; rounds grow with the logarithm of the
    longest path. Nulls and loops are left out. Every round is a written table, so that lost executors cost one round; those before it are deleted.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = written(pairs, "components")
    last = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "components")
        drop_table(pairs)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v"), "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = written(small, "components")
        drop_table(large)
        state = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == last:
            break
        last = state
    roots = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("id"), "component").distinct())
