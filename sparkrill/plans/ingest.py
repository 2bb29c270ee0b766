"""Landing, normalising, reading and upserting: the sources and sinks over records made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrill.operators import upsert as U
from sparkrill.operators.quality import scored
from sparkrill.plans import base
from sparkrill.sources import jsonl, normalise
from sparkrill.storage import new_folder, written
from sparkrill.tables import table




def _landed(spark: SparkSession, source: str, raw: DataFrame) -> DataFrame:
    """raw as JSON lines in the landing folder, read back with the source's schema."""
    path = new_folder(spark, f"landed-{source}")
    raw.write.json(path)
    return normalise.landed(spark, source, path)


def _utc(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _raw_posts(source: str, rows: DataFrame) -> DataFrame:
    """The table's posts of a source in the shape in which its crawler lands them."""
    c = F.col
    if source == "hackernews":
        return rows.select(c("external_id").alias("objectID"), "title", c("content").alias("story_text"), "author", "url", c("score").alias("points"), "num_comments", F.unix_seconds("posted_at").alias("created_at_i"))
    if source == "devto":
        return rows.select(c("external_id").alias("id"), "title", c("content").alias("description"), F.struct(c("author").alias("username")).alias("user"), "url", c("score").alias("positive_reactions_count"), c("num_comments").alias("comments_count"), _utc("posted_at").alias("published_at"))
    if source == "lobsters":
        return rows.select(c("external_id").alias("short_id"), "title", c("content").alias("description"), c("author").alias("submitter_user"), _utc("posted_at").alias("created_at"), "url", "score", c("num_comments").alias("comment_count"))
    if source == "reddit":
        return rows.select(c("external_id").alias("id"), "title", c("content").alias("selftext"), "author", "subreddit", "url", c("permalink"), c("flair").alias("link_flair_text"), "over_18", "score", "num_comments", F.unix_seconds("posted_at").cast("double").alias("created_utc"))
    if source == "x":
        return rows.select(c("external_id").alias("id_str"), c("content").alias("rawContent"), F.struct(c("author").alias("username")).alias("user"), "url", c("score").alias("likeCount"), c("num_comments").alias("replyCount"), _utc("posted_at").alias("date"))
    if source == "threads":
        return rows.select(c("external_id").alias("id"), c("content").alias("text"), "author", "url", c("score").alias("likes"), c("num_comments").alias("replies"), _utc("posted_at").alias("posted_at"), _utc("fetched_at").alias("fetched_at"))
    if source == "ptt":
        return rows.select(F.lit("b").alias("board"), c("external_id").alias("aid"), "title", "content", "author", "url", c("score").cast("string").alias("nrec"), _utc("posted_at").alias("posted_at"), _utc("fetched_at").alias("fetched_at"))
    return rows.select(F.concat(F.lit("https://example.org/posts/"), F.regexp_replace("external_id", "[^A-Za-z0-9]", "")).alias("permalink"), c("content").alias("text"), "author", c("score").alias("likes"), _utc("posted_at").alias("posted_at"), _utc("fetched_at").alias("fetched_at"))


def normalised_posts(spark: SparkSession, d: str) -> DataFrame:
    """All posts, landed as raw JSON by source, normalised and united; by source with checksums of what came through."""
    rows = base.posts(spark, d)
    frames = [normalise.posts_of(s, _landed(spark, s, _raw_posts(s, rows.filter(F.col("source") == s)))) for s in normalise.RAW]
    return normalise.united(frames).select("source", "external_id", F.length("title").alias("title_length"), F.length("content").alias("content_length"), "author", "score", "num_comments", F.unix_seconds("posted_at").alias("posted"))


_SIMPLE = "length(title) AS title_length, length(coalesce(content, '')) AS content_length, author, coalesce(score, 0) AS score, coalesce(num_comments, 0) AS num_comments, CAST(floor(epoch(posted_at)) AS BIGINT) AS posted"
_TRIMMED = "trim(coalesce(content, ''), ' ')"
_LATIN_AI = "regexp_matches(lower({0}), '(^|[^a-z])(({1})([^a-z]|$)|({2}))') OR regexp_matches({0}, '{3}')"
_STAMP = "CAST(floor(epoch(coalesce(posted_at, fetched_at))) AS BIGINT) AS posted"


def _ai(text: str) -> str:
    from sparkrill.functions import text as T

    return "(" + _LATIN_AI.format(text, "|".join(T.AI_STRICT), "|".join(T.AI_LOOSE), "|".join(T.AI_ZH)) + ")"


def _normalised_sql() -> str:
    from sparkrill.functions import text as T

    title = "length(CASE WHEN substring({0}, 1, 120) = '' THEN '{1}' ELSE substring({0}, 1, 120) END) AS title_length"
    body = f"length({_TRIMMED}) AS content_length, author"
    simplified = f"length({_TRIMMED}) - length(regexp_replace({_TRIMMED}, '[{T.SIMPLIFIED}]', '', 'g')) >= 2"
    named = " OR ".join(f"regexp_matches({_TRIMMED}, '{T.alias_pattern(s)}')" for s in T.ALIASES)
    digits = "md5(substring(" + _TRIMMED + ", 1, 200))"
    return f"""
SELECT source, external_id, {_SIMPLE} FROM posts WHERE source IN ('hackernews', 'devto', 'lobsters')
UNION ALL SELECT source, external_id, length(title), length(coalesce(content, '')), author, score, num_comments, CAST(floor(epoch(posted_at)) AS BIGINT) FROM posts WHERE source = 'reddit'
UNION ALL SELECT source, external_id, {title.format(_TRIMMED, '(tweet)')}, {body}, coalesce(score, 0), coalesce(num_comments, 0), CAST(floor(epoch(posted_at)) AS BIGINT) FROM posts WHERE source = 'x'
UNION ALL SELECT source, external_id, {title.format(_TRIMMED, '(post)')}, {body}, coalesce(score, 0), coalesce(num_comments, 0), {_STAMP} FROM posts WHERE source = 'threads' AND length({_TRIMMED}) > 20 AND NOT ({simplified}) AND ({named} OR {_ai(_TRIMMED)})
UNION ALL SELECT source, concat_ws('/', 'b', external_id), length(CASE WHEN coalesce(title, '') = '' THEN '(untitled)' ELSE title END), length(coalesce(content, '')), author, coalesce(score, 0), 0, {_STAMP} FROM posts WHERE source = 'ptt' AND {_ai('title')}
UNION ALL SELECT source, CASE WHEN regexp_replace(external_id, '[^A-Za-z0-9]', '', 'g') <> '' THEN regexp_replace(external_id, '[^A-Za-z0-9]', '', 'g') ELSE 'h' || substring({digits}, 1, 16) END, {title.format(_TRIMMED, '(post)')}, {body}, coalesce(score, 0), 0, {_STAMP} FROM posts WHERE source = 'facebook' AND length({_TRIMMED}) >= 30
"""


def normalised_releases(spark: SparkSession, d: str) -> DataFrame:
    """All release events, landed as raw JSON of the two release sources and normalised: uploads by organisation, releases without drafts."""
    rows = table(spark, d, "release_events")
    c = F.col
    uploads = rows.select(F.concat(F.when(c("id") % 3 == 0, "google/").when(c("id") % 3 == 1, "openai/").otherwise("meta-llama/"), F.when(c("id") % 2 == 0, "gemma-").otherwise("m-"), c("id").cast("string")).alias("id"), _utc("published_at").alias("createdAt"), c("id").alias("downloads"))
    drafts = rows.select("repo", F.when(c("id") % 5 != 0, F.concat(F.lit("n"), c("id").cast("string"))).alias("node_id"), F.coalesce("version", c("id").cast("string")).alias("tag_name"), F.when(c("id") % 4 == 0, F.lit("")).otherwise(c("title")).alias("name"), c("url").alias("html_url"), F.when(c("id") % 2 == 0, _utc("published_at")).alias("published_at"), _utc("fetched_at").alias("created_at"), (c("id") % 7 == 0).alias("draft"))
    frames = [normalise.releases_of("huggingface", _landed(spark, "huggingface", uploads)), normalise.releases_of("github", _landed(spark, "github", drafts))]
    return normalise.united(frames).select("source", "external_id", "model", "title", "kind", "version", F.unix_seconds("published_at").alias("published"))


NORMALISED_RELEASES = """
WITH u AS (SELECT (CASE id % 3 WHEN 0 THEN 'google/' WHEN 1 THEN 'openai/' ELSE 'meta-llama/' END) || (CASE WHEN id % 2 = 0 THEN 'gemma-' ELSE 'm-' END) || id AS name, id, published_at FROM release_events)
SELECT 'huggingface' AS source, name AS external_id, CASE id % 3 WHEN 0 THEN 'gemini' WHEN 1 THEN 'gpt' ELSE 'llama' END AS model, split_part(name, '/', 2) AS title, 'model_upload' AS kind, CAST(NULL AS VARCHAR) AS version, CAST(floor(epoch(published_at)) AS BIGINT) AS published FROM u WHERE id % 3 <> 0 OR id % 2 = 0
UNION ALL SELECT 'github', CASE WHEN id % 5 <> 0 THEN 'n' || id ELSE concat_ws('@', repo, coalesce(version, CAST(id AS VARCHAR))) END,
  CASE repo WHEN 'meta-llama/llama-models' THEN 'llama' WHEN 'meta-llama/llama-cookbook' THEN 'llama' WHEN 'deepseek-ai/DeepSeek-V3' THEN 'deepseek' WHEN 'deepseek-ai/DeepSeek-R1' THEN 'deepseek' WHEN 'google-deepmind/gemma' THEN 'gemini' WHEN 'openai/openai-python' THEN 'gpt' WHEN 'openai/codex' THEN 'gpt' WHEN 'anthropics/anthropic-sdk-python' THEN 'claude' WHEN 'anthropics/claude-code' THEN 'claude' END,
  CASE WHEN id % 4 = 0 OR coalesce(title, '') = '' THEN coalesce(version, CAST(id AS VARCHAR)) ELSE title END, 'github_release', coalesce(version, CAST(id AS VARCHAR)), CAST(floor(epoch(CASE WHEN id % 2 = 0 THEN coalesce(published_at, fetched_at) ELSE fetched_at END)) AS BIGINT)
FROM release_events WHERE id % 7 <> 0
"""


def _lines(spark: SparkSession, rows: DataFrame, name: str, *extra: str) -> str:
    """rows as one folder of JSON lines, with blank and broken lines beside them."""
    path = new_folder(spark, name)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).unionByName(spark.createDataFrame([(line,) for line in extra], "value string")).write.text(path)
    return path


def jsonl_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels written as JSON lines among blank and broken ones, and read back; a missing file adds nothing."""
    gold = table(spark, d, "gold_labels").select("post_id", "source", "sentiment", "quality", "round", "theme")
    schema = "post_id bigint, source string, sentiment string, quality string, round int, theme string"
    path = _lines(spark, gold, "labels", "", "   ", "{broken", "[1]")
    rows = jsonl.read_jsonl(spark, path, schema).unionByName(jsonl.read_jsonl(spark, f"{path}-none", schema))
    return rows.filter("post_id is not null").groupBy("source", "sentiment", "quality", "round", "theme").agg(F.count("*").alias("n"))


def score_join(spark: SparkSession, d: str) -> DataFrame:
    """Two systems' scores, read from files that name the field differently and hold several lines of one id, joined by id: who scores higher."""
    moods = table(spark, d, "sentiments").groupBy("post_id").agg(F.max("score").alias("score"))
    topics = table(spark, d, "themes").groupBy("post_id").agg(F.max("confidence").alias("confidence"))
    one = _lines(spark, moods.select(F.col("post_id").cast("string").alias("event_id"), F.col("score").alias("faithfulness")), "scores-a", "", '{"faithfulness": 1}', '{"event_id": "none"}')
    two = _lines(spark, topics.select(F.col("post_id").cast("string").alias("event_id"), F.col("confidence").cast("string").alias("faithfulness_score")), "scores-b")
    a, b = jsonl.score_file(spark, one), jsonl.score_file(spark, two)
    rows = a.withColumnRenamed("score", "a").join(b.withColumnRenamed("score", "b"), "id")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.round(F.avg(F.col("a") - F.col("b")), 9).alias("delta"))


SCORE_JOIN = "SELECT count(*) AS n, count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a < b) AS losses, round(avg(a - b), 9) AS delta FROM (SELECT post_id, max(score) AS a FROM sentiments GROUP BY 1) s JOIN (SELECT post_id, max(confidence) AS b FROM themes GROUP BY 1) t ON t.post_id = s.post_id"


def served_events(spark: SparkSession, d: str) -> DataFrame:
    """The newest releases as an events file, read back as they are served: ids, themes and citation numbers that are missing are filled in."""
    rows = table(spark, d, "release_events").orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(5).coalesce(1)
    c = F.col
    events = rows.select(c("id").alias("event_id"), "title", F.concat(F.lit("About "), "title").alias("summary"), F.array(F.struct(F.lit(None).cast("int").alias("n"), c("url").alias("url"), F.lit("p").alias("post_id"))).alias("citations"), F.lit("3").alias("member_count"), F.when(c("id") % 2 == 0, base.THEMES[1]).otherwise("?").alias("theme"))
    path = new_folder(spark, "events")
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.text(path)
    return jsonl.served_events(spark, path).select("id", "title", "summary", F.get("citations", F.lit(0))["n"].alias("n"), "member_count", "theme")


SERVED_EVENTS = "SELECT CAST(id AS VARCHAR) AS id, coalesce(title, '') AS title, 'About ' || title AS summary, 1 AS n, 3 AS member_count, CASE WHEN id % 2 = 0 THEN '新工具' ELSE '其他' END AS theme FROM (SELECT * FROM release_events ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 5) WHERE title IS NOT NULL"


def backfill_months(spark: SparkSession, d: str) -> DataFrame:
    """The months that a backfill of all posts walks through, with the posts in each half-open window."""
    span = base.posts(spark, d).agg(F.min("posted_at"), F.max("posted_at")).first()
    low, high = (base.posts(spark, d).select(F.date_format(f(F.col("posted_at")), "yyyy-MM-dd").alias("x")).first().x for f in (F.min, F.max)) if span[0] else ("2026-01-01", "2026-01-01")
    windows = normalise.backfill_windows(spark, low, high)
    months = base.posts(spark, d).filter("posted_at is not null").groupBy(F.date_trunc("month", "posted_at").alias("start"), (F.col("posted_at") < F.lit(high).cast("timestamp")).alias("inside")).agg(F.count("*").alias("n")).filter("inside")
    return F.broadcast(windows).join(months, "start", "left").select(F.to_date("start").alias("month"), F.to_date("end").alias("until"), F.coalesce("n", F.lit(0)).alias("n"))


BACKFILL_MONTHS = """
WITH s AS (SELECT date_trunc('month', min(posted_at)) AS a, CAST(CAST(max(posted_at) AS DATE) AS TIMESTAMP) AS b FROM posts), w AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), b, INTERVAL 1 MONTH)) AS DATE) AS month, b FROM s),
c AS (SELECT CAST(date_trunc('month', posted_at) AS DATE) AS month, count(*) AS n FROM posts WHERE posted_at < (SELECT b FROM s) GROUP BY 1)
SELECT w.month, CAST(least(w.month + INTERVAL 1 MONTH, b) AS DATE) AS until, coalesce(c.n, 0) AS n FROM w LEFT JOIN c ON c.month = w.month WHERE w.month < b
"""


def release_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The releases after an upsert of the later half, which names models by slug, known or not, and has new titles."""
    rows = table(spark, d, "release_events").filter("source is not null and external_id is not null")
    dim = base.models(spark, d)
    late = F.col("id") % 2 == 0
    columns = ["id", "source", "external_id", "model_id", "title", "url", "kind", "version", "extra"]
    stored = U.last_wins(rows.filter(~late | (F.col("id") % 6 == 0)).select(*columns), U.KEY, F.col("id"))
    batch = rows.filter(late).join(F.broadcast(dim.select(F.col("id").alias("model_id"), "slug")), "model_id", "left").select("id", "source", "external_id", F.coalesce("slug", F.lit("unknown")).alias("model"), F.concat(F.lit("New: "), "title").alias("title"), "url", "kind", "version", "extra")
    return U.releases_upserted(stored, batch, dim, F.col("id")).select("id", "source", "external_id", "model_id", "title")


RELEASE_UPSERT = """
WITH r AS (SELECT * FROM release_events WHERE source IS NOT NULL AND external_id IS NOT NULL),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY id DESC) AS k FROM r WHERE NOT (id % 2 = 0) OR id % 6 = 0) WHERE k = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY id DESC) AS k FROM r WHERE id % 2 = 0) WHERE k = 1)
SELECT coalesce(s.id, b.id) AS id, coalesce(s.source, b.source) AS source, coalesce(s.external_id, b.external_id) AS external_id, CASE WHEN b.id IS NOT NULL THEN m.id ELSE s.model_id END AS model_id, CASE WHEN b.id IS NOT NULL THEN 'New: ' || b.title ELSE s.title END AS title
FROM s FULL JOIN b ON b.source = s.source AND b.external_id = s.external_id LEFT JOIN models m ON m.id = b.model_id
"""


def label_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The sentiments in a bucketed table after two runs, the second with the labels of even posts turned to neutral; one row for each post."""
    columns = "post_id bigint, label string, score double, analyzed_at timestamp"
    rows = base.sentiments(spark, d).select("post_id", "label", "score", "analyzed_at")
    store = U.Snapshots(spark, new_folder(spark, "sentiments"), columns)
    order = F.col("analyzed_at")
    store.upsert(rows, ["post_id"], ["label", "score", "analyzed_at"], ["post_id", "label"], order)
    store.upsert(rows.filter("post_id % 2 = 0").withColumn("label", F.lit("neutral")), ["post_id"], ["label", "score", "analyzed_at"], ["post_id", "label"], order)
    return store.read().select("post_id", "label", "score")


LABEL_UPSERT = "SELECT post_id, CASE WHEN post_id % 2 = 0 THEN 'neutral' ELSE label END AS label, score FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY analyzed_at DESC) AS k FROM (SELECT DISTINCT * FROM sentiments) WHERE label IS NOT NULL) WHERE k = 1"


def event_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Events kept by dedup_key, after a run that finds the later ones again with a new score."""
    from sparkrill.plans import events

    rows = written(events.launches(spark, d).select("dedup_key", F.col("slug").alias("model"), F.col("n").cast("double").alias("score")), "event-rows")
    store = U.Snapshots(spark, new_folder(spark, "events"), "dedup_key string, model string, score double")
    store.upsert(rows, ["dedup_key"], ["score"], ["dedup_key"], F.col("score"))
    store.upsert(rows.filter("score > 1").withColumn("score", F.col("score") + 100), ["dedup_key"], ["score"], ["dedup_key"], F.col("score"))
    return store.read()


def model_seed(spark: SparkSession, d: str) -> DataFrame:
    """The models after a seed run with one changed and one new row."""
    stored = base.models(spark, d).select("slug", "name", "company", "role", "aliases")
    seeds = spark.createDataFrame([("gpt", "GPT next", "Open", "chat", ["gpt"]), ("zeta", "Zeta", "Z", None, ["zeta"])], stored.schema)
    return U.seeded(stored, seeds).select("slug", "name", "company", F.array_join("aliases", ",").alias("aliases"))


MODEL_SEED = "SELECT slug, CASE slug WHEN 'gpt' THEN 'GPT next' ELSE name END AS name, CASE slug WHEN 'gpt' THEN 'Open' ELSE company END AS company, CASE slug WHEN 'gpt' THEN 'gpt' ELSE array_to_string(aliases, ',') END AS aliases FROM models UNION ALL SELECT 'zeta', 'Zeta', 'Z', 'zeta'"


def quality_drained(posts: DataFrame, now: Column) -> DataFrame:
    """posts after the quality job: those that were never checked get score, flags and the time, the others stay as they are."""
    pending = posts.filter("dq_processed_at is null")
    checked = scored(pending).withColumn("dq_processed_at", now)
    return posts.filter("dq_processed_at is not null").unionByName(checked.select(*posts.columns))


def quality_backlog(spark: SparkSession, d: str) -> DataFrame:
    """By source, the posts that the quality job found unchecked, what it left unchecked, and the rows it must not touch."""
    columns = ["id", "source", "title", "content", "author", "models", "quality_score", "quality_flags", "dq_processed_at"]
    before = base.posts(spark, d).select(*columns)
    after = quality_drained(before, F.lit("2100-01-01").cast("timestamp"))
    drained = F.col("dq_processed_at") == F.lit("2100-01-01").cast("timestamp")
    sums = F.sum(F.when(~drained, F.col("quality_score")))
    return after.groupBy("source").agg(F.count_if(drained).alias("drained"), F.count_if(F.col("dq_processed_at").isNull() | (drained & F.col("quality_score").isNull())).alias("pending"), F.count_if(~drained).alias("kept"), sums.alias("kept_scores"))


QUALITY_BACKLOG = "SELECT source, count(*) FILTER (WHERE dq_processed_at IS NULL) AS drained, CAST(0 AS BIGINT) AS pending, count(dq_processed_at) AS kept, CAST(sum(quality_score) FILTER (WHERE dq_processed_at IS NOT NULL) AS BIGINT) AS kept_scores FROM posts GROUP BY source"


def flags_written(spark: SparkSession, d: str) -> DataFrame:
    """The posts table after the duplicate flags are written back: how many posts hold each kind of flag."""
    from sparkrill.plans import texts

    rows = base.posts(spark, d).select("id", "source", "quality_flags").join(texts.duplicate_flags(spark, d).withColumnRenamed("quality_flags", "new"), "id")
    store = U.Snapshots(spark, new_folder(spark, "flags"), "id bigint, source string, quality_flags array<string>")
    store.write(rows.select("id", "source", F.col("new").alias("quality_flags")), ["id"])
    return store.read().filter(F.array_contains("quality_flags", "DUPLICATE")).groupBy("source").agg(F.count("*").alias("n"))


def backlog_page(spark: SparkSession, d: str, n: int = 200) -> DataFrame:
    """The next n unchecked posts, the earliest fetched first."""
    return base.posts(spark, d).filter("dq_processed_at is null").orderBy("fetched_at", "id").limit(n).select("id", "fetched_at")


def loose_gate(spark: SparkSession, d: str) -> DataFrame:
    """Posts behind the loose gate and the strict one, by source."""
    return base.posts(spark, d).groupBy("source").agg(F.count_if(base.loose_gate()).alias("loose"), F.count_if(base.gate()).alias("strict"))


def annotation_queue(spark: SparkSession, d: str, n: int = 50) -> DataFrame:
    """What to label next: posts behind the loose gate whose theme is unsure and which nobody has labelled, in hash order."""
    unsure = base.themes(spark, d).filter("not confident").select(F.col("post_id").alias("id"))
    done = table(spark, d, "gold_labels").select(F.col("post_id").alias("id"))
    rows = base.posts(spark, d).filter(base.loose_gate()).select("id", "source").join(unsure, "id", "left_semi").join(done, "id", "left_anti")
    return rows.withColumn("h", F.md5(F.col("id").cast("string"))).orderBy("h", "id").limit(n).select("id", "source")


ANNOTATION_QUEUE = f"SELECT id, source FROM posts WHERE (quality_score IS NULL OR quality_score >= {base.QUALITY_MIN}) AND id IN (SELECT post_id FROM themes WHERE NOT confident) AND id NOT IN (SELECT post_id FROM gold_labels) ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 50"


def silver_export(spark: SparkSession, d: str) -> DataFrame:
    """Training rows (text, label) of checked posts with a theme, as written to and read from JSON lines: rows and characters by label."""
    strict = (F.col("quality_score") >= base.QUALITY_MIN) & ~F.coalesce(F.array_contains("quality_flags", "DUPLICATE"), F.lit(False))
    text = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("content", F.lit(""))))
    rows = base.posts(spark, d).filter(strict).select("id", text.alias("text")).join(base.themes(spark, d).select(F.col("post_id").alias("id"), "label"), "id").filter("length(text) >= 5 and label <> ''")
    path = new_folder(spark, "silver")
    jsonl.write_jsonl(rows.select("text", "label"), path)
    return jsonl.read_jsonl(spark, path, "text string, label string", strict=True).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


SILVER_EXPORT = f"""
WITH {base.SQL_THEMES}, r AS (SELECT trim(coalesce(title, '') || '. ' || coalesce(content, ''), ' ') AS text, t.label FROM posts p JOIN th t ON t.post_id = p.id WHERE quality_score >= {base.QUALITY_MIN} AND NOT coalesce(list_contains(quality_flags, 'DUPLICATE'), false) AND label <> '')
SELECT label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM r WHERE length(text) >= 5 GROUP BY label
"""


def _flags_sql() -> str:
    from sparkrill.plans import texts

    return f"WITH dups AS ({texts.NEAR_DUP_CLUSTERS}) SELECT p.source, count(*) AS n FROM dups JOIN posts p ON p.id = dups.id WHERE dups.canonical_id <> dups.id GROUP BY p.source"


def _events_sql() -> str:
    from sparkrill.plans import events

    return f"SELECT dedup_key, slug AS model, CAST(n AS DOUBLE) + CASE WHEN n > 1 THEN 100 ELSE 0 END AS score FROM ({events.LAUNCHES})"


QUERIES = {
    "normalised_posts": (normalised_posts, _normalised_sql()),
    "normalised_releases": (normalised_releases, NORMALISED_RELEASES),
    "jsonl_labels": (jsonl_labels, "SELECT source, sentiment, quality, round, theme, count(*) AS n FROM gold_labels GROUP BY ALL"),
    "score_join": (score_join, SCORE_JOIN),
    "served_events": (served_events, SERVED_EVENTS),
    "backfill_months": (backfill_months, BACKFILL_MONTHS),
    "release_upsert": (release_upsert, RELEASE_UPSERT),
    "label_upsert": (label_upsert, LABEL_UPSERT),
    "event_upsert": (event_upsert, _events_sql()),
    "model_seed": (model_seed, MODEL_SEED),
    "quality_backlog": (quality_backlog, QUALITY_BACKLOG),
    "flags_written": (flags_written, _flags_sql()),
    "backlog_page": (backlog_page, "SELECT id, fetched_at FROM posts WHERE dq_processed_at IS NULL ORDER BY fetched_at, id LIMIT 200"),
    "loose_gate": (loose_gate, f"SELECT source, count(*) FILTER (WHERE quality_score IS NULL OR quality_score >= {base.QUALITY_MIN}) AS loose, count(*) FILTER (WHERE {base.SQL_GATE}) AS strict FROM posts GROUP BY source"),
    "annotation_queue": (annotation_queue, ANNOTATION_QUEUE),
    "silver_export": (silver_export, SILVER_EXPORT),
}
