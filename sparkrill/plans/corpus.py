"""Corpus statistics, browsing, freshness and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrill.plans import base
from sparkrill.tables import table

# Fewest posts a day of a source, and most minutes without a new one.
VOLUME_MIN = {"hackernews": 20, "devto": 5, "threads": 5}
LAG_MAX = 240


def buckets_api(score: str = "quality_score") -> Column:
    return F.when(F.col(score) >= 30, "high").when((F.col(score) >= 15) | F.col(score).isNull(), "mid").otherwise("low")


def buckets_metrics(score: str = "quality_score") -> Column:
    return F.when(F.col(score).isNull(), "unchecked").when(F.col(score) >= 60, "high").when(F.col(score) >= 30, "mid").otherwise("low")


def buckets_report(score: str = "quality_score") -> Column:
    return F.when(F.col(score).isNull(), "null").when(F.col(score) >= 70, "high").when(F.col(score) >= 30, "mid").otherwise("low")


def quality_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The three definitions of quality buckets in one pass."""
    kinds = [("api", buckets_api()), ("metrics", buckets_metrics()), ("report", buckets_report())]
    pairs = F.array(*[F.struct(F.lit(name).alias("kind"), column.alias("bucket")) for name, column in kinds])
    return base.posts(spark, d).select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.bucket").agg(F.count("*").alias("n"))


QUALITY_BUCKETS = """
SELECT kind, bucket, count(*) AS n FROM (
  SELECT 'api' AS kind, CASE WHEN quality_score >= 30 THEN 'high' WHEN quality_score >= 15 OR quality_score IS NULL THEN 'mid' ELSE 'low' END AS bucket FROM posts
  UNION ALL SELECT 'metrics', CASE WHEN quality_score IS NULL THEN 'unchecked' WHEN quality_score >= 60 THEN 'high' WHEN quality_score >= 30 THEN 'mid' ELSE 'low' END FROM posts
  UNION ALL SELECT 'report', CASE WHEN quality_score IS NULL THEN 'null' WHEN quality_score >= 70 THEN 'high' WHEN quality_score >= 30 THEN 'mid' ELSE 'low' END FROM posts
) GROUP BY kind, bucket
"""


def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts under several conditions in one aggregation, by source."""
    return base.posts(spark, d).groupBy("source").agg(
        F.count("*").alias("n"),
        F.count_if(base.gate()).alias("n_gated"),
        F.count_if(F.col("quality_score").isNull()).alias("n_unchecked"),
        F.count_if(F.coalesce(F.array_contains("quality_flags", "DELETED"), F.lit(False))).alias("n_deleted"),
        F.max("score").alias("top_score"),
        F.max("posted_at").alias("last_posted"),
    )


CONDITIONAL_COUNTS = f"""
SELECT source, count(*) AS n, count(*) FILTER (WHERE {base.SQL_GATE}) AS n_gated, count(*) FILTER (WHERE quality_score IS NULL) AS n_unchecked,
  count(*) FILTER (WHERE coalesce(list_contains(quality_flags, 'DELETED'), false)) AS n_deleted, max(score) AS top_score, max(posted_at) AS last_posted
FROM posts GROUP BY source
"""


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Total and counts by source, theme and sentiment: one pass over posts with both labels, by grouping sets."""
    labelled = (
        base.posts(spark, d)
        .select("id", "source")
        .join(base.themes(spark, d).select(F.col("post_id").alias("id"), F.col("label").alias("theme")), "id", "left")
        .join(base.sentiments(spark, d).select(F.col("post_id").alias("id"), F.col("label").alias("sentiment")), "id", "left")
    )
    fused = labelled.groupingSets([[F.col("source")], [F.col("theme")], [F.col("sentiment")], []], "source", "theme", "sentiment").agg(F.count("*").alias("n"), F.grouping_id("source", "theme", "sentiment").alias("g"))
    kind = F.when(F.col("g") == 3, "source").when(F.col("g") == 5, "theme").when(F.col("g") == 6, "sentiment").otherwise("total")
    return fused.select(kind.alias("kind"), F.coalesce("source", "theme", "sentiment").alias("name"), "n")


CORPUS_STATS = f"""
WITH {base.SQL_SENT}, {base.SQL_THEMES}, l AS (SELECT p.id, p.source, t.label AS theme, s.label AS sentiment FROM posts p LEFT JOIN th t ON t.post_id = p.id LEFT JOIN sent s ON s.post_id = p.id)
SELECT 'source' AS kind, source AS name, count(*) AS n FROM l GROUP BY source
UNION ALL SELECT 'theme', theme, count(*) FROM l GROUP BY theme
UNION ALL SELECT 'sentiment', sentiment, count(*) FROM l GROUP BY sentiment
UNION ALL SELECT 'total', NULL, count(*) FROM l
"""


def corpus_page(spark: SparkSession, d: str, source: str = "hackernews", limit: int = 20, offset: int = 20) -> DataFrame:
    """One page of a source's posts, newest first, with labels and the independent total."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset at least 0")
    rows = base.posts(spark, d).filter(F.col("source") == source)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.select("id", "title", "posted_at", "score").orderBy(F.desc_nulls_last("posted_at"), F.desc("id")).offset(offset).limit(limit)
    theme = base.themes(spark, d).select(F.col("post_id").alias("id"), F.col("label").alias("theme"))
    mood = base.sentiments(spark, d).select(F.col("post_id").alias("id"), F.col("label").alias("sentiment"))
    # The page is of bounded size, and total one row.
    return F.broadcast(page).join(theme, "id", "left").join(mood, "id", "left").crossJoin(F.broadcast(total))


CORPUS_PAGE = f"""
WITH {base.SQL_SENT}, {base.SQL_THEMES}, page AS (SELECT id, title, posted_at, score FROM posts WHERE source = 'hackernews' ORDER BY posted_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20)
SELECT p.*, t.label AS theme, s.label AS sentiment, (SELECT count(*) FROM posts WHERE source = 'hackernews') AS total FROM page p LEFT JOIN th t ON t.post_id = p.id LEFT JOIN sent s ON s.post_id = p.id
"""


def top_authors(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """The authors with most posts of each source."""
    counts = base.posts(spark, d).filter("author is not null and author <> ''").groupBy("source", "author").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "author"))
    return counts.withColumn("place", rank).filter(F.col("place") <= n)


TOP_AUTHORS = """
SELECT * FROM (SELECT source, author, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, author) AS place FROM (SELECT source, author, count(*) AS n FROM posts WHERE author IS NOT NULL AND author <> '' GROUP BY source, author)) WHERE place <= 5
"""


def year_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Posts by year with their share; the null year holds posts without a time."""
    counts = base.posts(spark, d).groupBy(F.year("posted_at").cast("bigint").alias("year")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


YEAR_COVERAGE = "SELECT year, n, n / sum(n) OVER () AS share FROM (SELECT CAST(year(posted_at) AS BIGINT) AS year, count(*) AS n FROM posts GROUP BY 1)"


def freshness_lag(spark: SparkSession, d: str) -> DataFrame:
    """Minutes since each watched source brought a post, at the time of the last fetch; a source without any is stale."""
    watched = spark.createDataFrame([(s, LAG_MAX) for s in VOLUME_MIN], "source string, max_minutes int")
    last = base.posts(spark, d).groupBy("source").agg(F.max("fetched_at").alias("last"))
    as_of = base.posts(spark, d).agg(F.max("fetched_at").alias("as_of"))
    lag = F.floor((F.unix_micros("as_of") - F.unix_micros("last")) / 60_000_000)
    joined = F.broadcast(watched).join(last, "source", "left").crossJoin(F.broadcast(as_of))
    return joined.select("source", lag.alias("lag_minutes"), (F.col("last").isNull() | (lag > F.col("max_minutes"))).alias("stale"))


FRESHNESS_LAG = """
WITH w(source, max_minutes) AS (VALUES ('hackernews', 240), ('devto', 240), ('threads', 240)), l AS (SELECT source, max(fetched_at) AS last FROM posts GROUP BY source), a AS (SELECT max(fetched_at) AS as_of FROM posts)
SELECT w.source, CAST(floor((epoch_us(as_of) - epoch_us(last)) / 60000000) AS BIGINT) AS lag_minutes, last IS NULL OR floor((epoch_us(as_of) - epoch_us(last)) / 60000000) > max_minutes AS stale FROM w LEFT JOIN l ON l.source = w.source CROSS JOIN a
"""


def volume_threshold(spark: SparkSession, d: str, hours: int = 24) -> DataFrame:
    """Posts of each watched source within the last hours against the least it should bring."""
    least = spark.createDataFrame(list(VOLUME_MIN.items()), "source string, least int")
    as_of = base.newest(base.posts(spark, d), "fetched_at")
    recent = base.posts(spark, d).filter(F.col("fetched_at") > base.moment(as_of, hours / 24))
    counts = recent.groupBy("source").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(least).join(counts, "source", "left").select("source", n.alias("n"), (n >= F.col("least")).alias("enough"))


VOLUME_THRESHOLD = """
WITH w(source, least) AS (VALUES ('hackernews', 20), ('devto', 5), ('threads', 5)), c AS (SELECT source, count(*) AS n FROM posts WHERE fetched_at > (SELECT max(fetched_at) FROM posts) - INTERVAL 24 HOURS GROUP BY source)
SELECT w.source, coalesce(n, 0) AS n, coalesce(n, 0) >= least AS enough FROM w LEFT JOIN c ON c.source = w.source
"""


def metrics_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """(metric, label, value): the gauges of an exposition endpoint."""
    p = base.posts(spark, d)
    parts = [
        p.agg(F.lit("posts_total").alias("metric"), F.lit("").alias("label"), F.count("*").alias("value")),
        p.groupBy("source").agg(F.count("*").alias("value")).select(F.lit("posts_by_source").alias("metric"), F.col("source").alias("label"), "value"),
        p.groupBy(buckets_metrics().alias("label")).agg(F.count("*").alias("value")).select(F.lit("posts_by_quality").alias("metric"), "label", "value"),
        p.filter(F.col("fetched_at") > base.moment(base.newest(p, "fetched_at"), 1)).agg(F.lit("posts_24h").alias("metric"), F.lit("").alias("label"), F.count("*").alias("value")),
        base.sentiments(spark, d).groupBy("label").agg(F.count("*").alias("value")).select(F.lit("sentiments").alias("metric"), "label", "value"),
        base.themes(spark, d).groupBy("label").agg(F.count("*").alias("value")).select(F.lit("themes").alias("metric"), "label", "value"),
        base.bridge(p.select("id", "models"), spark, d).groupBy("slug").agg(F.count("*").alias("value")).select(F.lit("posts_by_model").alias("metric"), F.col("slug").alias("label"), "value"),
        table(spark, d, "release_events").groupBy("source").agg(F.count("*").alias("value")).select(F.lit("releases").alias("metric"), F.col("source").alias("label"), "value"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


METRICS_SNAPSHOT = f"""
WITH {base.SQL_SENT}, {base.SQL_THEMES}, {base.SQL_BRIDGE.format('posts')}
SELECT 'posts_total' AS metric, '' AS label, count(*) AS value FROM posts
UNION ALL SELECT 'posts_by_source', source, count(*) FROM posts GROUP BY source
UNION ALL SELECT 'posts_by_quality', CASE WHEN quality_score IS NULL THEN 'unchecked' WHEN quality_score >= 60 THEN 'high' WHEN quality_score >= 30 THEN 'mid' ELSE 'low' END, count(*) FROM posts GROUP BY 2
UNION ALL SELECT 'posts_24h', '', count(*) FROM posts WHERE fetched_at > (SELECT max(fetched_at) FROM posts) - INTERVAL 24 HOURS
UNION ALL SELECT 'sentiments', label, count(*) FROM sent GROUP BY label
UNION ALL SELECT 'themes', label, count(*) FROM th GROUP BY label
UNION ALL SELECT 'posts_by_model', slug, count(*) FROM bridge GROUP BY slug
UNION ALL SELECT 'releases', source, count(*) FROM release_events GROUP BY source
"""


def source_labels(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent sentiment of each source and its share, and the share of negative posts."""
    rows = base.posts(spark, d).select(F.col("id").alias("post_id"), "source").join(base.sentiments(spark, d).select("post_id", "label"), "post_id")
    counts = rows.groupBy("source", "label").agg(F.count("*").alias("n"))
    by = counts.groupBy("source").agg(F.max_by("label", F.struct("n", "label")).alias("dominant"), F.max("n").alias("top"), F.sum("n").alias("total"), F.sum(F.when(F.col("label") == "negative", F.col("n")).otherwise(0)).alias("bad"))
    return by.select("source", "dominant", (F.col("top") / F.col("total")).alias("share"), (F.col("bad") / F.col("total")).alias("negative_share"))


SOURCE_LABELS = f"""
WITH {base.SQL_SENT}, c AS (SELECT p.source, s.label, count(*) AS n FROM posts p JOIN sent s ON s.post_id = p.id GROUP BY 1, 2)
SELECT source, arg_max(label, (n, label)) AS dominant, max(n) / sum(n) AS share, sum(CASE WHEN label = 'negative' THEN n ELSE 0 END) / sum(n) AS negative_share FROM c GROUP BY source
"""

QUERIES = {
    "quality_buckets": (quality_buckets, QUALITY_BUCKETS),
    "conditional_counts": (conditional_counts, CONDITIONAL_COUNTS),
    "corpus_stats": (corpus_stats, CORPUS_STATS),
    "corpus_page": (corpus_page, CORPUS_PAGE),
    "top_authors": (top_authors, TOP_AUTHORS),
    "year_coverage": (year_coverage, YEAR_COVERAGE),
    "freshness_lag": (freshness_lag, FRESHNESS_LAG),
    "volume_threshold": (volume_threshold, VOLUME_THRESHOLD),
    "metrics_snapshot": (metrics_snapshot, METRICS_SNAPSHOT),
    "source_labels": (source_labels, SOURCE_LABELS),
}
