"""Cutoffs of many groups at once, found by parallel bisection over all rows.

A group's cutoff is the smallest value v whose rows at or below v carry a total weight of at least
the group's need. Every round splits each open group's bounds into `fanout` equal intervals and
weighs the rows of all groups in all intervals in one aggregation with map-side combining, so no
group's rows ever meet in one task, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrill.storage import written


def cutoffs(rows: DataFrame, needs: DataFrame, group: str, value: str, weight: str | None = None, fanout: int = 64) -> DataFrame:
    """Cutoffs of the groups in `needs` (group, need).

    rows: group, value (bigint) and perhaps weight (bigint, null counts 0). Null groups or values take no part.
    Returns group, cutoff, below (weight strictly under the cutoff value), at (weight on it), one row for each
    group of needs that has a need above 0 and that much weight; groups with less weight have no row, as all
    their rows are within. Ties on a value stay together: the caller settles them by a second call on another value.
    Empty tables give an empty result.
    """
    measure = F.coalesce(F.col(weight).cast("bigint"), F.lit(0)) if weight else F.lit(1).cast("bigint")
    rows = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("bigint").alias("v"), measure.alias("w"))
    needs = needs.filter(F.col("need") > 0).select(F.col(group).alias("g"), F.col("need").cast("bigint").alias("need"))
    rows = written(rows.join(needs.select("g"), "g", "left_semi"), "bisect-rows")
    bounds = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("total")).join(needs, "g").filter("total >= need").select("g", "lo", "hi", "need", F.lit(0).cast("bigint").alias("below"))
    bounds = written(bounds, "bisect-bounds")
    done: list[DataFrame] = []
    while True:
        open_rows = rows.join(bounds, "g").filter("v between lo and hi")
        # An interval is ceil((hi - lo + 1) / fanout) values wide; the subtraction is made in decimal(38), which bigint bounds can't overflow.
        width = F.expr(f"cast(ceil((cast(hi as decimal(38,0)) - lo + 1) / {fanout}) as decimal(38,0))")
        part = F.expr("cast(floor((cast(v as decimal(38,0)) - lo) / width) as int)")
        weighed = open_rows.withColumn("width", width).withColumn("part", part).groupBy("g", "lo", "hi", "need", "below", "width", "part").agg(F.sum("w").alias("w"), F.min("v").alias("first"), F.max("v").alias("last"))
        running = F.sum("w").over(W.partitionBy("g").orderBy("part"))
        hit = weighed.withColumn("upto", F.col("below") + running).filter("upto >= need").withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("part"))).filter("n = 1")
        bounds = written(hit.select("g", F.col("first").alias("lo"), F.col("last").alias("hi"), "need", (F.col("upto") - F.col("w")).alias("below"), F.col("w").alias("at")), "bisect-bounds")
        done.append(bounds.filter("lo = hi"))
        bounds = bounds.filter("lo < hi").drop("at")
        if bounds.isEmpty():
            break
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(F.col("g").alias(group), F.col("lo").alias("cutoff"), "below", "at")
