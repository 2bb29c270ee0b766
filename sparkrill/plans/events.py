"""Detected events: discussion spikes, launches, sentiment flips, and their reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrill.operators import sentiment as mood
from sparkrill.operators.spikes import gap_filled, spikes
from sparkrill.plans import base
from sparkrill.tables import table

KINDS = ("discussion_spike", "launch", "sentiment_flip")


def _event_days(spark: SparkSession, d: str, entity: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col(entity).alias("entity"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def daily_volume(spark: SparkSession, d: str) -> DataFrame:
    return gap_filled(_event_days(spark, d, "event_type"), "entity")


_SPINE = "spine AS (SELECT entity, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT entity, min(day) AS a, max(day) AS b FROM c GROUP BY entity)), filled AS (SELECT s.entity, s.day, coalesce(c.n, 0) AS n FROM spine s LEFT JOIN c ON c.entity IS NOT DISTINCT FROM s.entity AND c.day = s.day)"


def _counts_sql(entity: str) -> str:
    return f"c AS (SELECT {entity} AS entity, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)"


DAILY_VOLUME = f"WITH {_counts_sql('event_type')}, {_SPINE} SELECT entity, day, n FROM filled"

_SCORED = """
b AS (SELECT entity, day, n, median(CAST(n AS DOUBLE)) OVER f AS median, list(CAST(n AS DOUBLE)) OVER f AS base, count(*) OVER f AS n_base FROM filled WINDOW f AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, 0.6745 * (n - median) / greatest(list_median(list_transform(base, lambda x: abs(x - median))), 1.0) AS z FROM b),
hits AS (SELECT entity, day, n, round_even(z, 2) AS modified_z, round_even(least(z, 10.0), 2) AS severity, median FROM z WHERE n_base >= 5 AND n >= 5 AND z >= 3.5 AND n > median)
"""


def spikes_type(spark: SparkSession, d: str) -> DataFrame:
    return spikes(_event_days(spark, d, "event_type"), "entity")


def spikes_user(spark: SparkSession, d: str) -> DataFrame:
    return spikes(_event_days(spark, d, "user_id"), "entity")


def discussion_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Spikes of each model's daily posts, with the title of the day's highest-scored post, of equal ones the smallest id."""
    rows = base.bridge(base.gated(spark, d).filter("posted_at is not null").select("id", "title", "score", "posted_at", "models"), spark, d).withColumn("day", F.to_date("posted_at"))
    best = F.max_by("title", F.struct(F.coalesce("score", F.lit(0)), -F.col("id")))
    per_day = rows.groupBy("slug", "day").agg(F.count("*").alias("n"), best.alias("top_post"))
    found = spikes(per_day.select("slug", "day", "n"), "slug")
    return found.join(per_day.select("slug", "day", "top_post"), ["slug", "day"]).withColumn("dedup_key", F.concat_ws(":", F.lit("discussion_spike"), "slug", F.col("day").cast("string")))


DISCUSSION_SPIKES = f"""
WITH {base.SQL_GATED}, {base.SQL_BRIDGE.format("(SELECT id, title, score, CAST(posted_at AS DATE) AS day, models FROM gated WHERE posted_at IS NOT NULL)")},
top AS (SELECT slug, day, count(*) AS n, arg_max(title, (coalesce(score, 0), -id)) AS top_post FROM bridge GROUP BY 1, 2), c AS (SELECT slug AS entity, day, n FROM top), {_SPINE}, {_SCORED}
SELECT h.entity AS slug, h.day, h.n, h.modified_z, h.severity, h.median, t.top_post, 'discussion_spike:' || h.entity || ':' || CAST(h.day AS VARCHAR) AS dedup_key FROM hits h JOIN top t ON t.slug = h.entity AND t.day = h.day
"""


def launches(spark: SparkSession, d: str) -> DataFrame:
    """Releases of one model and day together: count, first five titles, kinds. A missing model is a group; prereleases don't count."""
    releases = table(spark, d, "release_events").filter(~F.coalesce(F.get_json_object("extra", "$.prerelease") == "true", F.lit(False)))
    dim = base.models(spark, d).select(F.col("id").alias("model_id"), "slug")
    rows = releases.join(F.broadcast(dim), "model_id", "left").withColumn("day", F.to_date("published_at"))
    titles = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("published_at", "id", "title"))), 1, 5), lambda x: x["title"])
    grouped = rows.groupBy("slug", "day").agg(F.count("*").alias("n"), titles.alias("titles"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return grouped.withColumn("dedup_key", F.concat_ws(":", F.lit("launch"), F.coalesce("slug", F.lit("_unknown")), F.col("day").cast("string")))


LAUNCHES = """
SELECT m.slug, CAST(r.published_at AS DATE) AS day, count(*) AS n, list_slice(list(r.title ORDER BY r.published_at, r.id), 1, 5) AS titles, list_sort(list_distinct(list(r.kind))) AS kinds,
  'launch:' || coalesce(m.slug, '_unknown') || ':' || CAST(CAST(r.published_at AS DATE) AS VARCHAR) AS dedup_key
FROM release_events r LEFT JOIN models m ON m.id = r.model_id WHERE NOT coalesce(json_extract_string(CASE WHEN json_valid(r.extra) THEN r.extra END, '$.prerelease') = 'true', false) GROUP BY 1, 2
"""


def flips(spark: SparkSession, d: str) -> DataFrame:
    """Each model's mood in the last 14 days against the 14 before, anchored at the newest scored post."""
    scored = base.gated(spark, d).select("id", "posted_at", "models").join(base.sentiments(spark, d).select(F.col("post_id").alias("id"), "label", "score", "p_positive", "p_negative"), "id")
    rows = base.bridge(scored, spark, d)
    newest = base.newest(rows, "posted_at")
    dated = rows.filter(F.col("posted_at") >= base.moment(newest, 28))
    period = F.when(F.col("posted_at") >= base.moment(newest, 14), "curr").otherwise("prev")
    by = dated.groupBy("slug", period.alias("period")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "negative").alias("bad"), mood.index().alias("index"))
    wide = by.groupBy("slug").agg(*[F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{p}_{c}") for p in ("prev", "curr") for c in ("n", "bad", "index")])
    filled = wide.select("slug", *[F.coalesce(c, F.lit(0)).alias(c) for c in wide.columns if c != "slug"])
    z = mood.two_proportion_z(F.col("curr_bad"), F.col("curr_n"), F.col("prev_bad"), F.col("prev_n"))
    return filled.withColumn("z", F.round(z, 6)).withColumn("direction", mood.flip_direction(F.col("prev_index"), F.col("curr_index"), F.col("prev_n"), F.col("curr_n"), z))


FLIPS = f"""
WITH {base.SQL_GATED}, {base.SQL_SENT}, {base.SQL_BRIDGE.format("(SELECT g.id, g.posted_at, g.models, s.label, s.score, s.p_positive, s.p_negative FROM gated g JOIN sent s ON s.post_id = g.id)")},
dated AS (SELECT *, CASE WHEN posted_at >= newest - INTERVAL 14 DAYS THEN 'curr' ELSE 'prev' END AS period FROM bridge CROSS JOIN (SELECT max(posted_at) AS newest FROM bridge) WHERE posted_at >= newest - INTERVAL 28 DAYS),
b AS (SELECT slug, period, count(*) AS n, count(*) FILTER (WHERE label = 'negative') AS bad, CASE WHEN sum(score) > 0 THEN CAST(round_even(100 * (sum(score * (p_positive - p_negative)) / sum(score) * (count(score) / (count(score) + 3.0))), 0) AS INTEGER) END AS index FROM dated GROUP BY 1, 2),
w AS (SELECT slug, {", ".join(f"coalesce(max({c}) FILTER (WHERE period = '{p}'), 0) AS {p}_{c}" for p in ("prev", "curr") for c in ("n", "bad", "index"))} FROM b GROUP BY slug),
t AS (SELECT *, (prev_bad + curr_bad) / (prev_n + curr_n) AS pooled FROM w),
u AS (SELECT *, CASE WHEN prev_n > 0 AND curr_n > 0 AND pooled * (1 - pooled) > 0 THEN (curr_bad / curr_n - prev_bad / prev_n) / sqrt(pooled * (1 - pooled) * (1 / curr_n + 1 / prev_n)) ELSE 0 END AS zz FROM t)
SELECT slug, prev_n, prev_bad, prev_index, curr_n, curr_bad, curr_index, round(zz, 6) AS z,
  CASE WHEN prev_n >= 5 AND curr_n >= 5 AND abs(zz) > 1.959963984540054 AND prev_index <= -20 AND curr_index >= 20 THEN 'to_positive' WHEN prev_n >= 5 AND curr_n >= 5 AND abs(zz) > 1.959963984540054 AND prev_index >= 20 AND curr_index <= -20 THEN 'to_negative' END AS direction
FROM u
"""


def detected_events(spark: SparkSession, d: str) -> DataFrame:
    """All three kinds in one shape: dedup_key, event_type, model, score, occurred_at."""
    spike = discussion_spikes(spark, d).select("dedup_key", F.lit(KINDS[0]).alias("event_type"), F.col("slug").alias("model"), F.col("severity").alias("score"), F.col("day").alias("occurred_on"))
    launch = launches(spark, d).select("dedup_key", F.lit(KINDS[1]).alias("event_type"), F.col("slug").alias("model"), F.col("n").cast("double").alias("score"), F.col("day").alias("occurred_on"))
    turned = flips(spark, d).filter("direction is not null")
    day = base.posts(spark, d).agg(F.date_sub(F.to_date(F.max("posted_at")), 14).alias("day"))
    flip = turned.crossJoin(F.broadcast(day)).select(F.concat_ws(":", F.lit(KINDS[2]), "slug", F.col("day").cast("string")).alias("dedup_key"), F.lit(KINDS[2]).alias("event_type"), F.col("slug").alias("model"), F.abs(F.col("curr_index") - F.col("prev_index")).cast("double").alias("score"), F.col("day").alias("occurred_on"))
    return spike.unionByName(launch).unionByName(flip)


DETECTED = f"""
WITH s AS ({DISCUSSION_SPIKES}), l AS ({LAUNCHES}), f AS ({FLIPS})
SELECT dedup_key, 'discussion_spike' AS event_type, slug AS model, severity AS score, day AS occurred_on FROM s UNION ALL SELECT dedup_key, 'launch', slug, CAST(n AS DOUBLE), day FROM l
UNION ALL SELECT 'sentiment_flip:' || slug || ':' || CAST(day AS VARCHAR), 'sentiment_flip', slug, CAST(abs(curr_index - prev_index) AS DOUBLE), day FROM f CROSS JOIN (SELECT CAST(max(posted_at) AS DATE) - 14 AS day FROM posts) WHERE direction IS NOT NULL
"""


def reconciled(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The stored events after a run: those found replace their key, stored ones of the detected kinds that weren't found go, others stay. An empty run deletes nothing."""
    some = found.limit(1).select(F.lit(True).alias("any"))
    rest = stored.join(found.select("dedup_key"), "dedup_key", "left_anti").join(F.broadcast(some), F.lit(True), "left")
    kept = rest.filter(~F.col("event_type").isin(*KINDS) | F.col("any").isNull()).drop("any")
    return found.unionByName(kept)


def recent_releases(spark: SparkSession, d: str, limit: int = 20) -> DataFrame:
    """The newest releases with their model, known or not."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    newest = table(spark, d, "release_events").orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(limit)
    return newest.join(base.models(spark, d).select(F.col("id").alias("model_id"), "slug"), "model_id", "left").select("id", "title", "slug", "kind", "published_at")


RECENT_RELEASES = "SELECT r.id, r.title, m.slug, r.kind, r.published_at FROM (SELECT * FROM release_events ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 20) r LEFT JOIN models m ON m.id = r.model_id"

QUERIES = {
    "spikes_type": (spikes_type, f"WITH {_counts_sql('event_type')}, {_SPINE}, {_SCORED} SELECT * FROM hits"),
    "spikes_user": (spikes_user, f"WITH {_counts_sql('user_id')}, {_SPINE}, {_SCORED} SELECT * FROM hits"),
    "daily_volume_gapfilled": (daily_volume, DAILY_VOLUME),
    "discussion_spikes": (discussion_spikes, DISCUSSION_SPIKES),
    "launches": (launches, LAUNCHES),
    "sentiment_flips": (flips, FLIPS),
    "detected_events": (detected_events, DETECTED),
    "recent_releases": (recent_releases, RECENT_RELEASES),
}
