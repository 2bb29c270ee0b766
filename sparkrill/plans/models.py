"""Per-model dashboards, details, comparison, and the theme feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrill.operators import sentiment as mood
from sparkrill.plans import base
from sparkrill.tables import table


def _as_of(spark: SparkSession, d: str) -> int | None:
    return base.newest(base.posts(spark, d), "fetched_at")


def _scored(spark: SparkSession, d: str, gated: bool = True) -> DataFrame:
    rows = base.gated(spark, d) if gated else base.posts(spark, d)
    pairs = rows.select("id", "posted_at", "models").join(base.sentiments(spark, d).select(F.col("post_id").alias("id"), "label", "score", "p_positive", "p_negative"), "id")
    return base.bridge(pairs, spark, d)


def sentiment_index(spark: SparkSession, d: str) -> DataFrame:
    """Index, polarisation and label of each model."""
    n, good, bad = F.count("*"), F.count_if(F.col("label") == "positive"), F.count_if(F.col("label") == "negative")
    by = _scored(spark, d).groupBy("slug").agg(n.alias("n"), good.alias("n_positive"), bad.alias("n_negative"), mood.index().alias("index"))
    return by.withColumn("polarization", mood.polarisation(F.col("n_positive"), F.col("n_negative"), F.col("n"))).withColumn("label", mood.index_label(F.col("index")))


_SCORED = "(SELECT g.id, g.posted_at, g.models, s.label, s.score, s.p_positive, s.p_negative FROM {0} g JOIN sent s ON s.post_id = g.id)"
_INDEX = "CASE WHEN sum(score) > 0 THEN CAST(round_even(100 * (sum(score * (p_positive - p_negative)) / sum(score) * (count(score) / (count(score) + 3.0))), 0) AS INTEGER) END"
SENTIMENT_INDEX = f"""
WITH {base.SQL_GATED}, {base.SQL_SENT}, {base.SQL_BRIDGE.format(_SCORED.format('gated'))},
b AS (SELECT slug, count(*) AS n, count(*) FILTER (WHERE label = 'positive') AS n_positive, count(*) FILTER (WHERE label = 'negative') AS n_negative, {_INDEX} AS index FROM bridge GROUP BY slug)
SELECT *, CAST(round_even(200 * least(n_positive, n_negative) / n, 0) AS INTEGER) AS polarization, CASE WHEN index > 10 THEN 'positive' WHEN index < -10 THEN 'negative' ELSE 'neutral' END AS label FROM b
"""


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Every model with its posts, recent posts, newest post, newest release and index; models without any keep their row."""
    posts = base.bridge(base.gated(spark, d).select("id", "posted_at", "models"), spark, d)
    counts = posts.groupBy("model_id").agg(F.count("*").alias("n_posts"), F.count_if(F.col("posted_at") >= base.moment(_as_of(spark, d), 7)).alias("n_recent"), F.max("posted_at").alias("last_post"))
    releases = table(spark, d, "release_events").groupBy("model_id").agg(F.max("published_at").alias("last_release"))
    moods = _scored(spark, d).groupBy("model_id").agg(mood.index().alias("index"))
    dim = base.models(spark, d).select(F.col("id").alias("model_id"), "slug", "name", "is_active")
    joined = dim.join(counts, "model_id", "left").join(releases, "model_id", "left").join(moods, "model_id", "left")
    return joined.select("slug", "name", "is_active", F.coalesce("n_posts", F.lit(0)).alias("n_posts"), F.coalesce("n_recent", F.lit(0)).alias("n_recent"), "last_post", "last_release", "index")


DASHBOARD = f"""
WITH {base.SQL_GATED}, {base.SQL_SENT}, {base.SQL_BRIDGE.format('gated')}, a AS (SELECT max(fetched_at) AS as_of FROM posts),
c AS (SELECT model_id, count(*) AS n_posts, count(*) FILTER (WHERE posted_at >= (SELECT as_of FROM a) - INTERVAL 7 DAYS) AS n_recent, max(posted_at) AS last_post FROM bridge GROUP BY model_id),
r AS (SELECT model_id, max(published_at) AS last_release FROM release_events GROUP BY model_id),
m2 AS (SELECT b.model_id, {_INDEX.replace('score', 's.score').replace('p_positive', 's.p_positive').replace('p_negative', 's.p_negative')} AS index FROM bridge b JOIN sent s ON s.post_id = b.id GROUP BY b.model_id)
SELECT m.slug, m.name, m.is_active, coalesce(n_posts, 0) AS n_posts, coalesce(n_recent, 0) AS n_recent, last_post, last_release, index FROM models m LEFT JOIN c ON c.model_id = m.id LEFT JOIN r ON r.model_id = m.id LEFT JOIN m2 ON m2.model_id = m.id
"""


def model_trend(spark: SparkSession, d: str, days: int = 30) -> DataFrame:
    """Posts and index of each model on each of the days + 1 days to the last fetch; days without posts count 0. Without the quality gate."""
    if not 7 <= days <= 90:
        raise ValueError("days is 7 to 90")
    spine = spark.range(1).select(F.to_date(base.moment(_as_of(spark, d))).alias("last")).filter("last is not null").select(F.explode(F.expr(f"sequence(date_sub(last, {int(days)}), last, INTERVAL 1 DAY)")).alias("day"))
    grid = base.models(spark, d).select("slug").crossJoin(F.broadcast(spine))
    counts = base.bridge(base.posts(spark, d).select("id", "posted_at", "models"), spark, d).groupBy("slug", F.to_date("posted_at").alias("day")).agg(F.count("*").alias("n"))
    moods = _scored(spark, d, False).groupBy("slug", F.to_date("posted_at").alias("day")).agg(mood.index().alias("index"))
    return grid.join(counts, ["slug", "day"], "left").join(moods, ["slug", "day"], "left").select("slug", "day", F.coalesce("n", F.lit(0)).alias("n"), "index")


MODEL_TREND = f"""
WITH {base.SQL_SENT}, {base.SQL_BRIDGE.format('(SELECT id, posted_at, models FROM posts)')}, a AS (SELECT CAST(max(fetched_at) AS DATE) AS d FROM posts),
grid AS (SELECT slug, CAST(unnest(generate_series(d - INTERVAL 30 DAYS, d, INTERVAL 1 DAY)) AS DATE) AS day FROM models CROSS JOIN a),
c AS (SELECT slug, CAST(posted_at AS DATE) AS day, count(*) AS n FROM bridge GROUP BY 1, 2), i AS (SELECT slug, CAST(posted_at AS DATE) AS day, {_INDEX} AS index FROM bridge b JOIN sent s ON s.post_id = b.id GROUP BY 1, 2)
SELECT g.slug, g.day, coalesce(n, 0) AS n, index FROM grid g LEFT JOIN c ON c.slug = g.slug AND c.day = g.day LEFT JOIN i ON i.slug = g.slug AND i.day = g.day
"""


def top_discussions(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """Each model's highest-scored posts, of equal ones the larger id first, with the link to show."""
    rows = base.bridge(base.posts(spark, d).select("id", "title", "score", "url", "permalink", "models"), spark, d)
    place = F.row_number().over(W.partitionBy("slug").orderBy(F.desc_nulls_last("score"), F.desc("id")))
    link = F.coalesce(F.nullif("url", F.lit("")), F.nullif("permalink", F.lit("")))
    return rows.withColumn("place", place).filter(F.col("place") <= n).select("slug", "place", "id", "title", "score", link.alias("link"))


TOP_DISCUSSIONS = f"""
WITH {base.SQL_BRIDGE.format('(SELECT id, title, score, url, permalink, models FROM posts)')}
SELECT slug, place, id, title, score, coalesce(nullif(url, ''), nullif(permalink, '')) AS link FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC NULLS LAST, id DESC) AS place FROM bridge) WHERE place <= 5
"""


def compare_recommend(spark: SparkSession, d: str, slugs: tuple[str, ...] = ("gpt", "claude", "gemini")) -> DataFrame:
    """The chosen models side by side, and which of them the index, then the number of posts, speaks for."""
    if not 1 <= len(slugs) <= 6:
        raise ValueError("one to six models")
    rows = dashboard(spark, d).filter(F.col("slug").isin(*[s.lower() for s in slugs]))
    best = rows.agg(F.max_by("slug", F.struct(F.coalesce("index", F.lit(-101)), F.col("n_posts"), F.col("slug"))).alias("best"))
    return rows.crossJoin(F.broadcast(best)).select("slug", "n_posts", "n_recent", "index", (F.col("slug") == F.col("best")).alias("recommended"))


COMPARE = f"WITH d AS ({DASHBOARD}), s AS (SELECT * FROM d WHERE slug IN ('gpt', 'claude', 'gemini')) SELECT slug, n_posts, n_recent, index, slug = (SELECT arg_max(slug, (coalesce(index, -101), n_posts, slug)) FROM s) AS recommended FROM s"


def topic_posts(spark: SparkSession, d: str, topic: str = "context window") -> DataFrame:
    """Posts that mention a topic in title or content, any case; % and _ in the topic are patterns."""
    pattern = f"%{topic}%"
    return base.posts(spark, d).filter(F.ilike("title", F.lit(pattern)) | F.ilike("content", F.lit(pattern))).select("id", "source", "title")


def feed(spark: SparkSession, d: str, days: int = 7, per_theme: int = 6, model: str | None = None, sentiment: str | None = None, source: str | None = None) -> DataFrame:
    """The newest posts of each theme within the last days, one plan for all themes, with what the filters leave."""
    if not 1 <= days <= 90 or not 1 <= per_theme <= 50:
        raise ValueError("days is 1 to 90, per_theme 1 to 50")
    rows = base.gated(spark, d).filter(F.col("posted_at") >= base.moment(_as_of(spark, d), days))
    if source:
        rows = rows.filter(F.col("source") == source)
    if model:
        named = base.bridge(rows.select("id", "models"), spark, d).filter(F.col("slug") == model).select("id")
        rows = rows.join(named, "id", "left_semi")
    label = base.themes(spark, d).select(F.col("post_id").alias("id"), base.theme_name().alias("theme"), "confidence")
    moods = base.sentiments(spark, d).select(F.col("post_id").alias("id"), F.col("label").alias("sentiment"))
    joined = rows.select("id", "source", "title", "content", "url", "permalink", "posted_at", "score").join(label, "id").join(moods, "id", "left")
    if sentiment:
        joined = joined.filter(F.col("sentiment") == sentiment)
    place = F.row_number().over(W.partitionBy("theme").orderBy(F.desc("posted_at"), F.desc("id")))
    ranked = joined.withColumn("place", place).filter((F.col("place") <= per_theme) & (F.col("theme") != base.THEMES[-1]))
    short = F.substring(F.regexp_replace(F.trim("content"), r"(?U)\s+", " "), 1, 160)
    return ranked.select("theme", "place", "id", "source", F.substring("title", 1, 120).alias("title"), short.alias("snippet"), F.coalesce(F.nullif("permalink", F.lit("")), F.nullif("url", F.lit(""))).alias("link"), "posted_at", "score", "sentiment", "confidence")


FEED = f"""
WITH {base.SQL_GATED}, {base.SQL_SENT}, {base.SQL_THEMES},
j AS (SELECT g.*, {base.SQL_THEME_NAME.replace('label', 't.label')} AS theme, t.confidence, s.label AS sentiment FROM gated g JOIN th t ON t.post_id = g.id LEFT JOIN sent s ON s.post_id = g.id WHERE posted_at >= (SELECT max(fetched_at) FROM posts) - INTERVAL 7 DAYS)
SELECT theme, place, id, source, substring(title, 1, 120) AS title, substring(regexp_replace(trim(content, ' '), '[\\s\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{85}}\\x0b]+', ' ', 'g'), 1, 160) AS snippet, coalesce(nullif(permalink, ''), nullif(url, '')) AS link, posted_at, score, sentiment, confidence
FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY posted_at DESC, id DESC) AS place FROM j) WHERE place <= 6 AND theme <> '其他'
"""


def feed_summary(spark: SparkSession, d: str, days: int = 7) -> DataFrame:
    """Posts of each theme within the last days; themes without any count 0, old names count for their new one."""
    names = spark.createDataFrame([(k, t) for k, t in enumerate(base.THEMES)], "place int, theme string")
    rows = base.gated(spark, d).filter(F.col("posted_at") >= base.moment(_as_of(spark, d), days)).select("id", "posted_at")
    counts = rows.join(base.themes(spark, d).select(F.col("post_id").alias("id"), base.theme_name().alias("theme")), "id").groupBy("theme").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "theme", "left").select("place", "theme", F.coalesce("n", F.lit(0)).alias("n"))


FEED_SUMMARY = f"""
WITH {base.SQL_GATED}, {base.SQL_THEMES}, w(place, theme) AS (VALUES (0, '模型動態'), (1, '新工具'), (2, '使用方法'), (3, '風險限制'), (4, '倫理法規'), (5, '其他')),
c AS (SELECT {base.SQL_THEME_NAME} AS theme, count(*) AS n FROM gated g JOIN th t ON t.post_id = g.id WHERE posted_at >= (SELECT max(fetched_at) FROM posts) - INTERVAL 7 DAYS GROUP BY 1)
SELECT w.place, w.theme, coalesce(n, 0) AS n FROM w LEFT JOIN c ON c.theme = w.theme
"""


def model_posts_semi(spark: SparkSession, d: str, slug: str = "claude") -> DataFrame:
    """Posts that name a model, by a semi-join."""
    named = base.bridge(base.posts(spark, d).select("id", "models"), spark, d).filter(F.col("slug") == slug).select("id")
    return base.posts(spark, d).join(named, "id", "left_semi").select("id", "source", "posted_at")


def theme_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Checked posts of enough quality that have no theme yet."""
    strict = (F.col("quality_score") >= base.QUALITY_MIN) & ~F.coalesce(F.array_contains("quality_flags", "DUPLICATE"), F.lit(False))
    return base.posts(spark, d).filter(strict).select("id", "fetched_at").join(table(spark, d, "themes").select(F.col("post_id").alias("id")), "id", "left_anti")


def highlights(spark: SparkSession, d: str, n: int = 3) -> DataFrame:
    """The most engaging posts of each theme: score plus comments, then the smaller id."""
    rows = base.gated(spark, d).select("id", "title", (F.coalesce("score", F.lit(0)) + F.coalesce("num_comments", F.lit(0))).alias("engagement")).join(base.themes(spark, d).select(F.col("post_id").alias("id"), base.theme_name().alias("theme")), "id")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("theme").orderBy(F.desc("engagement"), "id"))).filter(F.col("place") <= n)


HIGHLIGHTS = f"""
WITH {base.SQL_GATED}, {base.SQL_THEMES}, r AS (SELECT g.id, g.title, coalesce(score, 0) + coalesce(num_comments, 0) AS engagement, {base.SQL_THEME_NAME} AS theme FROM gated g JOIN th t ON t.post_id = g.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY engagement DESC, id) AS place FROM r) WHERE place <= 3
"""


def sentiment_movers(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """The most clearly positive and negative posts."""
    rows = base.sentiments(spark, d).filter(F.col("label").isin("positive", "negative"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "post_id"))).filter(F.col("place") <= n).select("label", "place", "post_id", "score")


MOVERS = f"WITH {base.SQL_SENT} SELECT label, place, post_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, post_id) AS place FROM sent WHERE label IN ('positive', 'negative')) WHERE place <= 5"

QUERIES = {
    "sentiment_index_by_model": (sentiment_index, SENTIMENT_INDEX),
    "dashboard_zero_preserving": (dashboard, DASHBOARD),
    "model_detail_trend": (model_trend, MODEL_TREND),
    "model_top_discussions": (top_discussions, TOP_DISCUSSIONS),
    "compare_recommend": (compare_recommend, COMPARE),
    "ilike_topic": (topic_posts, "SELECT id, source, title FROM posts WHERE title ILIKE '%context window%' OR content ILIKE '%context window%'"),
    "feed_topn": (feed, FEED),
    "feed_summary_zero_fill": (feed_summary, FEED_SUMMARY),
    "semi_join_model_posts": (model_posts_semi, "SELECT id, source, posted_at FROM posts WHERE list_contains(models, 'claude')"),
    "anti_join_backlog": (theme_backlog, "SELECT id, fetched_at FROM posts p WHERE quality_score >= 30 AND NOT coalesce(list_contains(quality_flags, 'DUPLICATE'), false) AND NOT EXISTS (SELECT 1 FROM themes t WHERE t.post_id = p.id)"),
    "highlights": (highlights, HIGHLIGHTS),
    "sentiment_movers": (sentiment_movers, MOVERS),
}
