"""Upserts, reconciliation and streams over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrill.operators import upsert as U
from sparkrill.plans import base, events
from sparkrill.storage import new_folder
from sparkrill.streaming import jobs
from sparkrill.tables import table

_COLUMNS = ["id", "source", "external_id", "title", "content", "score", "num_comments", "flair", "over_18", "author", "posted_at", "fetched_at"]
_ORDER = ["fetched_at", "id"]


def dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last fetch of each post."""
    return U.last_wins(base.posts(spark, d).select("id", "source", "external_id", "title", "score", "fetched_at"), U.KEY, F.struct(*_ORDER))


DEDUP_LAST_WINS = "SELECT id, source, external_id, title, score, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY fetched_at DESC, id DESC) AS k FROM posts) WHERE k = 1"


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """The posts of all batches but the last ten days', after the upsert of those days: columns that don't change keep their first values."""
    rows = base.posts(spark, d).select(*_COLUMNS)
    good, _ = U.valid(rows, U.REQUIRED)
    dated = good.withColumn("_late", F.col("fetched_at") >= base.moment(base.newest(rows, "fetched_at"), 10))
    stored = U.last_wins(dated.filter("not _late").drop("_late"), U.KEY, F.struct(*_ORDER))
    batch = U.last_wins(dated.filter("_late").drop("_late"), U.KEY, F.struct(*_ORDER))
    return U.merged(stored, batch, U.KEY, U.UPDATED)


UPSERT_MERGE = f"""
WITH g AS (SELECT {", ".join(_COLUMNS)}, fetched_at >= (SELECT max(fetched_at) FROM posts) - INTERVAL 10 DAYS AS late FROM posts WHERE source IS NOT NULL AND external_id IS NOT NULL AND title IS NOT NULL AND posted_at IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY late, source, external_id ORDER BY fetched_at DESC, id DESC) AS k FROM g), s AS (SELECT * FROM r WHERE k = 1 AND NOT late), b AS (SELECT * FROM r WHERE k = 1 AND late)
SELECT {", ".join(f"CASE WHEN b.id IS NOT NULL THEN b.{c} ELSE s.{c} END AS {c}" if c in U.UPDATED else f"CASE WHEN s.id IS NOT NULL THEN s.{c} ELSE b.{c} END AS {c}" for c in _COLUMNS)}
FROM s FULL OUTER JOIN b ON b.source = s.source AND b.external_id = s.external_id
"""


def post_model_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between posts and known models, each once."""
    return base.bridge(base.posts(spark, d).select(F.col("id").alias("post_id"), "models"), spark, d).select("post_id", "model_id")


def event_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The stored events after a run: of an earlier run's launches, those of models that are not active any more are not found again and go; events of other kinds stay."""
    found = events.launches(spark, d).select("dedup_key", F.lit("launch").alias("event_type"), F.col("slug").alias("model"))
    active = base.models(spark, d).filter("is_active").select(F.col("slug").alias("model"))
    stored = found.unionByName(spark.createDataFrame([("manual:1", "manual", None)], "dedup_key string, event_type string, model string"))
    return events.reconciled(stored, found.join(F.broadcast(active), "model", "left_semi"))


EVENT_RECONCILE = f"WITH l AS ({events.LAUNCHES}) SELECT dedup_key, 'launch' AS event_type, slug AS model FROM l WHERE slug IN (SELECT slug FROM models WHERE is_active) UNION ALL SELECT 'manual:1', 'manual', NULL"


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_to_end(jobs.daily_counts(jobs.file_stream(spark, d, "events"), "ts", "event_type"), "stream-daily")


def stream_sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_to_end(jobs.sliding_counts(jobs.file_stream(spark, d, "events"), "ts", "event_type"), "stream-sliding")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_to_end(jobs.sessions(jobs.file_stream(spark, d, "events"), "ts", "user_id"), "stream-sessions")


def stream_online_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Spikes of event types found online, day by day of the finished counts."""
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("entity"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    path = new_folder(spark, "day-counts")
    counts.write.parquet(path)
    stream = spark.readStream.schema(counts.schema).parquet(path)
    return jobs.run_to_end(jobs.online_spikes(stream), "stream-spikes", "append").withColumn("z", F.bround("z", 2))


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The posts table after its own rows came as a stream of micro-batches and were upserted by their key."""
    columns = ["id", "source", "external_id", "title", "score", "posted_at", "fetched_at"]
    stream = jobs.file_stream(spark, d, "posts").select(*columns, F.struct(*_ORDER).alias("at"))
    schema = "id bigint, source string, external_id string, title string, score int, posted_at timestamp, fetched_at timestamp, at struct<fetched_at:timestamp,id:bigint>"
    store = U.Snapshots(spark, new_folder(spark, "stream-posts"), schema)
    jobs.upsert_stream(stream, store, U.KEY, ["id", "title", "score", "fetched_at"], U.REQUIRED, "at", new_folder(spark, "stream-state"))
    return store.read().select("id", "source", "external_id", "title", "score")


STREAM_UPSERT = "SELECT id, source, external_id, title, score FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY fetched_at DESC, id DESC) AS k FROM posts WHERE source IS NOT NULL AND external_id IS NOT NULL AND title IS NOT NULL AND posted_at IS NOT NULL) WHERE k = 1"


def stream_chain(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that run when the data before them is there: posts land, pass the gate, and are counted by source."""
    folder = new_folder(spark, "chain")
    rows = base.posts(spark, d).select("id", "source", "quality_score", "quality_flags")
    rows.write.parquet(f"{folder}/landed/first")
    steps = [("gated", lambda batch: batch.filter(base.gate()).select("id", "source")), ("counted", lambda batch: batch.groupBy("source").agg(F.count("*").alias("n")))]
    jobs.chained(spark, folder, "id bigint, source string, quality_score int, quality_flags array<string>", steps)
    counts = spark.read.schema("source string, n bigint").option("recursiveFileLookup", "true").parquet(f"{folder}/counted")
    return counts.groupBy("source").agg(F.sum("n").alias("n"))


def trending_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The stored trending terms after a run replaced those of an earlier one."""
    from sparkrill.plans import texts

    store = U.Snapshots(spark, new_folder(spark, "trending"), "term string, z double, recent_count bigint, rank int")
    store.write(spark.createDataFrame([("old", 9.0, 1, 1)], "term string, z double, recent_count bigint, rank int"), ["term"])
    store.write(texts.trending_terms(spark, d), ["term"])
    return store.read()


def _trending_sql() -> str:
    from sparkrill.plans import texts

    return texts.TRENDING_TERMS


_HITS = events.QUERIES["spikes_type"][1]
QUERIES = {
    "dedup_last_wins": (dedup_last_wins, DEDUP_LAST_WINS),
    "upsert_merge": (upsert_merge, UPSERT_MERGE),
    "post_model_links": (post_model_links, "SELECT DISTINCT p.id AS post_id, m.id AS model_id FROM (SELECT id, unnest(models) AS s FROM posts) p JOIN models m ON m.slug = p.s"),
    "event_reconcile": (event_reconcile, EVENT_RECONCILE),
    "stream_upsert": (stream_upsert, STREAM_UPSERT),
    "stream_chain": (stream_chain, f"SELECT source, count(*) AS n FROM posts WHERE {base.SQL_GATE} GROUP BY source"),
    "trending_snapshot": (trending_snapshot, _trending_sql()),
    "stream_daily_counts": (stream_daily_counts, "SELECT event_type AS entity, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_sliding_counts": (stream_sliding_counts, "SELECT event_type AS entity, CAST(ts AS DATE) + CAST(k.range + 1 AS INTEGER) AS until, count(*) AS n FROM events CROSS JOIN range(7) k GROUP BY 1, 2"),
    "stream_sessions": (stream_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS entity, CAST(min(ts) AS TIMESTAMPTZ) AS started, CAST(max(ts) + INTERVAL 30 MINUTES AS TIMESTAMPTZ) AS ended, count(*) AS n FROM s GROUP BY user_id, k"),
    "stream_online_spikes": (stream_online_spikes, f"SELECT entity, day, n, modified_z AS z FROM ({_HITS})"),
}
