"""Raw records of each source as the one shape of posts, or of releases: one projection each, from landed JSON.

Fetching is not the engine's part: crawlers land raw JSON lines, and `landed` reads them in batch or as a stream. Fields that
a source lacks are null; a missing id, title or time stays null for the upsert to skip and count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrill.functions.text import is_ai_related, looks_simplified, match_models

POST_COLUMNS = "source external_id title content author subreddit url permalink flair over_18 score num_comments posted_at models".split()
# The fields read of each source's records.
RAW = {
    "hackernews": "objectID string, title string, story_text string, author string, url string, points int, num_comments int, created_at_i bigint",
    "devto": "id string, title string, description string, user struct<username:string>, url string, positive_reactions_count int, comments_count int, published_at string",
    "lobsters": "short_id string, title string, description_plain string, description string, submitter_user string, created_at string, url string, short_id_url string, comments_url string, score int, comment_count int",
    "reddit": "id string, title string, selftext string, author string, subreddit string, url string, permalink string, link_flair_text string, over_18 boolean, score int, num_comments int, created_utc double",
    "x": "id_str string, id bigint, rawContent string, user struct<username:string>, url string, likeCount int, retweetCount int, replyCount int, date string",
    "threads": "id string, text string, author string, url string, likes int, replies int, posted_at string, fetched_at string",
    "ptt": "board string, aid string, title string, content string, author string, url string, nrec string, posted_at string, fetched_at string",
    "facebook": "permalink string, text string, author string, likes int, posted_at string, fetched_at string",
}
RELEASES_RAW = {
    "huggingface": "id string, createdAt string, downloads bigint, likes bigint, pipeline_tag string, tags array<string>, gated string",
    "github": "repo string, node_id string, tag_name string, name string, html_url string, published_at string, created_at string, prerelease boolean, draft boolean, author struct<login:string>, body string",
}
# Whose uploads and releases speak for which model.
ORGS = {"meta-llama": "llama", "facebook": "llama", "deepseek-ai": "deepseek", "xai-org": "grok", "google": "gemini", "openai": "gpt", "Anthropic": "claude"}
REPOS = {
    "meta-llama/llama-models": "llama",
    "meta-llama/llama-cookbook": "llama",
    "deepseek-ai/DeepSeek-V3": "deepseek",
    "deepseek-ai/DeepSeek-R1": "deepseek",
    "google-deepmind/gemma": "gemini",
    "openai/openai-python": "gpt",
    "openai/codex": "gpt",
    "anthropics/anthropic-sdk-python": "claude",
    "anthropics/claude-code": "claude",
}


def landed(spark: SparkSession, source: str, path: str, stream: bool = False) -> DataFrame:
    """Raw JSON lines of a source with its schema; bad lines give null fields."""
    reader = spark.readStream if stream else spark.read
    return reader.schema({**RAW, **RELEASES_RAW}[source]).option("mode", "PERMISSIVE").json(path)


def _time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def _row(source: str, **fields: Column) -> list[Column]:
    text = F.concat(F.coalesce(fields["title"], F.lit("")), F.lit("\n"), F.coalesce(fields["content"], F.lit("")))
    values = {"source": F.lit(source), "models": match_models(text), "over_18": F.lit(False), **fields}
    kinds = {"over_18": "boolean", "score": "int", "num_comments": "int", "posted_at": "timestamp", "models": "array<string>"}
    return [values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in POST_COLUMNS]


def ptt_score(nrec: Column) -> Column:
    """The board's mark as a number: 爆 is 100, X and anything after it -10, no number 0."""
    return F.when(nrec == "爆", 100).when(nrec.startswith("X"), -10).otherwise(F.coalesce(nrec.try_cast("int"), F.lit(0)))


def posts_of(source: str, raw: DataFrame) -> DataFrame:
    """The posts of a source's raw records."""
    c, zero, empty = F.col, F.lit(0), F.lit("")
    if source == "hackernews":
        link = F.concat(F.lit("https://news.ycombinator.com/item?id="), c("objectID"))
        return raw.select(*_row(source, external_id=c("objectID"), title=c("title"), content=F.coalesce("story_text", empty), author=c("author"), url=c("url"), permalink=link, score=F.coalesce("points", zero), num_comments=F.coalesce("num_comments", zero), posted_at=F.timestamp_seconds(F.nullif("created_at_i", F.lit(0)))))
    if source == "devto":
        return raw.select(*_row(source, external_id=c("id"), title=c("title"), content=F.coalesce("description", empty), author=c("user.username"), url=c("url"), permalink=c("url"), score=F.coalesce("positive_reactions_count", zero), num_comments=F.coalesce("comments_count", zero), posted_at=_time(c("published_at"))))
    if source == "lobsters":
        name = F.coalesce(F.get_json_object("submitter_user", "$.username"), c("submitter_user"))
        body = F.coalesce(F.nullif("description_plain", empty), F.nullif("description", empty), empty)
        return raw.select(*_row(source, external_id=c("short_id"), title=c("title"), content=body, author=name, url=F.coalesce(F.nullif("url", empty), c("short_id_url")), permalink=F.coalesce(F.nullif("comments_url", empty), c("short_id_url")), score=F.coalesce("score", zero), num_comments=F.coalesce("comment_count", zero), posted_at=_time(c("created_at"))))
    if source == "reddit":
        return raw.select(*_row(source, external_id=c("id"), title=c("title"), content=F.coalesce("selftext", empty), author=c("author"), subreddit=c("subreddit"), url=c("url"), permalink=F.concat(F.lit("https://www.reddit.com"), c("permalink")), flair=c("link_flair_text"), over_18=F.coalesce("over_18", F.lit(False)), score=c("score"), num_comments=c("num_comments"), posted_at=F.timestamp_micros((c("created_utc") * 1_000_000).cast("bigint"))))
    if source == "x":
        text = F.trim(F.coalesce("rawContent", empty))
        return raw.select(*_row(source, external_id=F.coalesce(F.nullif("id_str", empty), c("id").cast("string")), title=F.coalesce(F.nullif(F.substring(text, 1, 120), empty), F.lit("(tweet)")), content=text, author=c("user.username"), url=c("url"), permalink=c("url"), score=F.coalesce("likeCount", zero) + F.coalesce("retweetCount", zero), num_comments=F.coalesce("replyCount", zero), posted_at=_time(c("date")), models=match_models(text)))
    if source == "threads":
        text = F.trim(F.coalesce("text", empty))
        rows = raw.filter((F.length(text) > 20) & ~looks_simplified(text) & ((F.size(match_models(text)) > 0) | is_ai_related(text)))
        return rows.select(*_row(source, external_id=c("id"), title=F.coalesce(F.nullif(F.substring(text, 1, 120), empty), F.lit("(post)")), content=text, author=c("author"), url=c("url"), permalink=c("url"), score=F.coalesce("likes", zero), num_comments=F.coalesce("replies", zero), posted_at=F.coalesce(_time(c("posted_at")), _time(c("fetched_at"))), models=match_models(text)))
    if source == "ptt":
        rows = raw.filter(is_ai_related(c("title")))
        return rows.select(*_row(source, external_id=F.concat_ws("/", "board", "aid"), title=F.coalesce(F.nullif("title", empty), F.lit("(untitled)")), content=F.coalesce("content", empty), author=c("author"), url=c("url"), score=ptt_score(F.trim("nrec")), num_comments=zero, posted_at=F.coalesce(_time(c("posted_at")), _time(c("fetched_at")))))
    if source == "facebook":
        text = F.trim(F.coalesce("text", empty))
        found = F.regexp_extract("permalink", r"(?:posts|permalink|videos|groups/[^/]+/posts)/([A-Za-z0-9]+)", 1)
        key = F.when(found != "", found).otherwise(F.concat(F.lit("h"), F.substring(F.md5(F.substring(text, 1, 200)), 1, 16)))
        rows = raw.filter(F.length(text) >= 30)
        return rows.select(*_row(source, external_id=key, title=F.substring(text, 1, 120), content=text, author=c("author"), url=c("permalink"), permalink=c("permalink"), score=F.coalesce("likes", zero), num_comments=zero, posted_at=F.coalesce(_time(c("posted_at")), _time(c("fetched_at"))), models=match_models(text)))
    raise ValueError(f"unknown source {source}")


def _slug(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[x for pair in table.items() for x in map(F.lit, pair)]), key)


def releases_of(source: str, raw: DataFrame, include_prereleases: bool = True) -> DataFrame:
    """Release rows (source, external_id, model, title, url, repo, kind, version, published_at, extra as JSON)."""
    c = F.col
    if source == "huggingface":
        org, name = F.substring_index("id", "/", 1), F.substring_index("id", "/", -1)
        rows = raw.filter(c("id").isNotNull() & ((org != "google") | F.lower("id").contains("gemma")))
        extra = F.to_json(F.struct(org.alias("author"), F.coalesce("downloads", F.lit(0)).alias("downloads"), F.coalesce("likes", F.lit(0)).alias("likes"), c("pipeline_tag"), F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 20).alias("tags"), c("gated")))
        return rows.select(F.lit(source).alias("source"), c("id").alias("external_id"), _slug(ORGS, org).alias("model"), name.alias("title"), F.concat(F.lit("https://huggingface.co/"), c("id")).alias("url"), c("id").alias("repo"), F.lit("model_upload").alias("kind"), F.lit(None).cast("string").alias("version"), _time(c("createdAt")).alias("published_at"), extra.alias("extra"))
    if source == "github":
        rows = raw.filter(~F.coalesce("draft", F.lit(False)))
        if not include_prereleases:
            rows = rows.filter(~F.coalesce("prerelease", F.lit(False)))
        extra = F.to_json(F.struct(F.coalesce("prerelease", F.lit(False)).alias("prerelease"), F.coalesce("draft", F.lit(False)).alias("draft"), c("author.login").alias("author"), F.substring(F.coalesce("body", F.lit("")), 1, 500).alias("body_excerpt")))
        key = F.coalesce(F.nullif("node_id", F.lit("")), F.concat_ws("@", "repo", "tag_name"))
        title = F.coalesce(F.nullif("name", F.lit("")), c("tag_name"), F.lit(""))
        return rows.select(F.lit(source).alias("source"), key.alias("external_id"), _slug(REPOS, c("repo")).alias("model"), title.alias("title"), c("html_url").alias("url"), "repo", F.lit("github_release").alias("kind"), c("tag_name").alias("version"), F.coalesce(_time(c("published_at")), _time(c("created_at"))).alias("published_at"), extra.alias("extra"))
    raise ValueError(f"unknown source {source}")


def united(frames: list[DataFrame]) -> DataFrame:
    """The sources' posts in one relation."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def backfill_windows(spark: SparkSession, since: str, until: str, weekly: bool = False) -> DataFrame:
    """(start, end): half-open windows of a month or seven days that cover since to until; the first month begins on its first day."""
    first = f"timestamp'{since}'" if weekly else f"date_trunc('month', timestamp'{since}')"
    step = "INTERVAL 7 DAYS" if weekly else "INTERVAL 1 MONTH"
    starts = spark.range(1).select(F.explode(F.expr(f"sequence({first}, timestamp'{until}', {step})")).alias("start")).filter(F.expr(f"start < timestamp'{until}'"))
    return starts.select("start", F.expr(f"least(start + {step}, timestamp'{until}')").alias("end"))
