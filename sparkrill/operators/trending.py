"""Terms that stand out lately: log-odds of document frequencies with a symmetric prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PRIOR, MIN_RECENT, TOP = 0.01, 5, 20


def log_odds(counts: DataFrame, prior: float = PRIOR, min_recent: int = MIN_RECENT) -> DataFrame:
    """(term, recent_count, z) of counts (term, recent, baseline); totals and vocabulary come from one aggregate row."""
    totals = counts.agg(F.sum("recent").alias("n1"), F.sum("baseline").alias("n2"), (F.lit(prior) * F.count("*")).alias("np"))
    rows = counts.filter(F.col("recent") >= min_recent).crossJoin(F.broadcast(totals))
    a1, a2 = F.col("recent") + F.lit(prior), F.col("baseline") + F.lit(prior)
    d1, d2 = F.col("n1") + F.col("np") - a1, F.col("n2") + F.col("np") - a2
    z = (F.ln(a1 / d1) - F.ln(a2 / d2)) / F.sqrt(1 / a1 + 1 / a2)
    return rows.filter((d1 > 0) & (d2 > 0)).select("term", F.col("recent").alias("recent_count"), z.alias("z"))


def trending(terms: DataFrame, top: int = TOP, prior: float = PRIOR, min_recent: int = MIN_RECENT) -> DataFrame:
    """(term, z, recent_count, rank) of terms (recent, term): a row for each text and distinct term, recent ones being part of the baseline."""
    counts = terms.groupBy("term").agg(F.count_if("recent").alias("recent"), F.count("*").alias("baseline"))
    best = log_odds(counts, prior, min_recent).withColumn("z", F.round("z", 3)).orderBy(F.desc("z"), "term").limit(top)
    # A rank over at most `top` rows.
    return best.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc("z"), "term")))
