"""Capping the records of dominant contributors, best quality first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrill.llm.accounts import account, source_name
from sparkrill.llm.bisect import cutoffs
from sparkrill.llm.prefilter import likely
from sparkrill.storage import written

_NULL_SCORE_RANK = 1 << 32


def capped(records: DataFrame, max_share: float | None = None, fanout: int = 2) -> DataFrame:
    """Which records of each contributor remain.

    records: id (bigint, unique), contributor (null: nobody's, always kept), score (int, null is lowest) and
    cap (most records of the contributor, the same on all its rows; null: no cap). With max_share a
    contributor also keeps at most that share of all records. The result is those four columns and the boolean
    `kept`: per contributor the `cap` records of the highest score, of equal ones those with the smaller id.

    Contributors over their cap are found by a partial aggregation. For those, bounds on the score are
    bisected for all contributors together, over counts by score; the ties at each cutoff score are then settled by bisecting the id,
    16 ways a round. Records of nobody and of contributors within their cap pass by without a shuffle.
    Repeated ids are settled as one id. An empty table gives an empty table.
    """
    rank = F.when(F.col("score").isNull(), F.lit(_NULL_SCORE_RANK)).otherwise(-F.col("score").cast("bigint"))
    rows = records.select("id", "contributor", "score", "cap").withColumn("_rank", rank)
    sizes = rows.filter("contributor is not null").groupBy("contributor").agg(F.count("*").alias("n"), F.max("cap").alias("cap"))
    if max_share is not None:
        share = F.floor(F.lit(float(max_share)) * rows.count()).cast("bigint")
        sizes = sizes.withColumn("cap", F.least(F.coalesce("cap", share), share))
    over = written(sizes.filter("cap is not null and n > cap").select("contributor", F.greatest(F.col("cap").cast("bigint"), F.lit(0)).alias("need")), "cap-over")
    ranks = rows.join(over.select("contributor"), "contributor").groupBy("contributor", "_rank").agg(F.count("*").alias("n"))
    at_score = cutoffs(ranks, over, "contributor", "_rank", "n", fanout)
    edge = written(over.join(at_score, "contributor", "left").select("contributor", F.col("cutoff").alias("_cut"), (F.col("need") - F.col("below")).alias("need"), "at"), "cap-edge")
    # Where all ties at the cutoff fit, no id needs a look.
    split = edge.filter("need < at")
    ties = rows.join(split.select("contributor", F.col("_cut").alias("_rank")), ["contributor", "_rank"]).select("contributor", "id")
    at_id = cutoffs(ties, split, "contributor", "id", None, max(fanout, 16)).select("contributor", F.col("cutoff").alias("_last"))
    rule = edge.select("contributor", "_cut", F.lit(True).alias("_over")).join(at_id, "contributor", "left")
    inside = (F.col("_rank") < F.col("_cut")) | ((F.col("_rank") == F.col("_cut")) & (F.col("_last").isNull() | (F.col("id") <= F.col("_last"))))
    # Few contributors are over their cap: each has more than cap records. Rows without a rule never take part in the join.
    rule = written(rule, "cap-rule")
    wanted = likely(rows.filter("contributor is not null").withColumn("_c", F.xxhash64("contributor")), rule.select(F.xxhash64("contributor").alias("_c")), "_c", split=True)
    judged = wanted.filter("_may").drop("_may", "_c").join(rule, "contributor", "left").withColumn("kept", F.col("_over").isNull() | F.coalesce(inside, F.lit(False))).drop("_rank", "_cut", "_over", "_last")
    rest = wanted.filter("not _may").drop("_may", "_c", "_rank").unionByName(rows.filter("contributor is null").drop("_rank")).withColumn("kept", F.lit(True))
    return judged.unionByName(rest.select(judged.columns))


def latest_fetch(posts: DataFrame) -> DataFrame:
    """The row of each post (source, external_id) with the latest fetched_at, then the larger id; a post without external_id is its own."""
    key = F.struct(F.coalesce(F.unix_micros("fetched_at"), F.lit(-(1 << 62))).alias("t"), F.col("id"))
    named = posts.filter("external_id is not null").groupBy("_source", "external_id").agg(F.max(key).alias("k")).select(F.col("k.id").alias("id"))
    return posts.join(named.unionByName(posts.filter("external_id is null").select("id")), "id", "left_semi")


def dropped_posts(posts: DataFrame, caps: DataFrame, fanout: int = 2) -> DataFrame:
    """Ids of the posts that contributor_caps (source, max_posts) removes. Sources without a row there, or with a null max_posts, have no cap."""
    rows = posts.select(F.col("id").cast("bigint").alias("id"), source_name(F.col("source")).alias("_source"), account(F.col("author"), F.col("source")).alias("_account"), "external_id", "fetched_at", F.col("quality_score").alias("score"))
    rows = written(rows, "cap-posts")
    limits = caps.filter("max_posts is not null").groupBy(source_name(F.col("source")).alias("_source")).agg(F.min("max_posts").alias("cap"))
    # A contributor is one account in one source.
    who = F.when(F.col("_account").isNotNull(), F.concat_ws("\u0001", "_source", "_account"))
    records = latest_fetch(rows).join(limits, "_source", "left").select("id", who.alias("contributor"), "score", "cap")
    return capped(records, None, fanout).filter("not kept").select("id")
