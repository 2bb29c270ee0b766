"""From posts to cited event summaries: cluster, extract key sentences, number the sources, generate, check, and gate for training.

The models are injected as factories (`operators.hooks`); every step is one relation with a row for each event, sentence or citation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrill.functions.text import event_key, first_filled, make_title, split_sentences
from sparkrill.operators import faithfulness as faith
from sparkrill.operators import hooks, vectors
from sparkrill.operators import summaries as S
from sparkrill.storage import written

THRESHOLD, MIN_SIZE, SENTENCES = 0.6, 2, 8


def clustered(posts: DataFrame, text: str, embed: Callable | None = None, threshold: float = THRESHOLD, min_size: int = MIN_SIZE) -> tuple[DataFrame, DataFrame]:
    """(events, vectors): events (event, id) with at least min_size posts, the event being its smallest id; vectors (id, v)."""
    embedded = written(hooks.with_vectors(posts.select("id", text), text, embed).select("id", "v"), "pipeline-vectors")
    found = vectors.threshold_clusters(embedded, threshold).select(F.col("cluster").alias("event"), "id")
    large = found.groupBy("event").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).select("event")
    return written(found.join(large, "event").select("event", "id"), "pipeline-events"), embedded


def key_sentences(events: DataFrame, posts: DataFrame, text: str, embed: Callable | None = None, k: int = SENTENCES) -> DataFrame:
    """(event, pos, post_id, text): k sentences of each event near its centre and unlike each other; pos is their place from 1. A sentence that several posts have is the first's."""
    parts = events.join(posts.select("id", text), "id").select("event", F.col("id").alias("post_id"), F.explode(split_sentences(F.col(text))).alias("text"))
    distinct = parts.groupBy("event", "text").agg(F.min("post_id").alias("post_id")).withColumn("id", F.xxhash64("event", "text"))
    rows = written(hooks.with_vectors(distinct, "text", embed), "pipeline-sentences")
    chosen = vectors.mmr(rows.select("id", "v", "event"), "event", k)
    return chosen.join(rows.select("id", "post_id", "text"), "id").select("event", F.col("place").alias("pos"), "post_id", "text")


def summarised(sentences: DataFrame, generate: Callable | None = None, nli: Callable | None = None, most: int = 8, language: str = "zh-Hant") -> DataFrame:
    """(event, summary, sources array<string>, issues, faithfulness_score) of the key sentences of each event."""
    sources = sentences.groupBy("event").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("sources"))
    prompts = S.source_block(sentences.select("event", "pos", "text")).select("event", S.prompt_of(F.col("sources"), most, language).alias("prompt"))
    raw = written(hooks.with_generated(prompts, "prompt", "raw", generate).select("event", S.parse_summary(F.col("raw")).alias("summary")).join(sources, "event").withColumn("n_sources", F.size("sources")), "pipeline-summaries")
    checked = S.validated(raw, "summary", "n_sources")
    judged = hooks.with_entailment(faith.sentences(raw.select(F.col("event").alias("id"), "summary", "sources")), "premise", "hypothesis", nli)
    scores = faith.report(judged, raw.select(F.col("event").alias("id"), "n_sources")).select(F.col("id").alias("event"), F.col("score").alias("faithfulness_score"))
    return checked.join(scores, "event", "left").select("event", "summary", "sources", "n_sources", "issues", F.coalesce("faithfulness_score", F.lit(0.0)).alias("faithfulness_score"))


def records(summaries: DataFrame, sentences: DataFrame, events: DataFrame, posts: DataFrame) -> DataFrame:
    """(event_id, title, summary, citations, member_count, theme, faithfulness_score, issues): the served shape. A citation is a cited number with
    the post of that key sentence; numbers without a sentence are left out. The title is the event's first post's.

    posts: id, title, content, url, source, theme.
    """
    cited = summaries.select("event", F.explode(F.array_distinct(S.extract_ids(F.col("summary")))).alias("n"))
    of = sentences.select("event", F.col("pos").alias("n"), "post_id").join(posts.select(F.col("id").alias("post_id"), "url", "source"), "post_id", "left")
    struct = F.struct("n", "url", "source", "post_id")
    citations = cited.join(of, ["event", "n"]).groupBy("event").agg(F.array_sort(F.collect_list(struct)).alias("citations"))
    members = events.groupBy("event").agg(F.count("*").alias("member_count"), F.min("id").alias("id"))
    head = members.join(posts.select("id", make_title(F.coalesce(first_filled(F.col("title"), F.col("content")), F.lit("(untitled)"))).alias("title"), "theme"), "id")
    rows = summaries.join(head, "event").join(citations, "event", "left")
    empty = F.array().cast("array<struct<n:int,url:string,source:string,post_id:bigint>>")
    return rows.select(F.concat(F.lit("event-"), F.col("event").cast("string")).alias("event_id"), "title", "summary", F.coalesce("citations", empty).alias("citations"), "member_count", "theme", F.round("faithfulness_score", 4).alias("faithfulness_score"), "issues")


def distilled(summaries: DataFrame, sentences: DataFrame, min_faithfulness: float = 0.5, require_ok: bool = True) -> DataFrame:
    """(event, status, event_key, input, output): each event with the first gate that stops it as a training record, else ok with the prompt and the summary."""
    keys = sentences.groupBy("event").agg(F.count("*").alias("n_sentences"), F.collect_set("post_id").alias("post_ids"))
    rows = S.gated_records(summaries.join(keys, "event", "left"), min_faithfulness, require_ok)
    block = S.source_block(sentences.select("event", "pos", "text"))
    ok = F.col("status") == S.STATUSES[-1]
    return rows.join(block.withColumnRenamed("sources", "lines"), "event", "left").select("event", "status", "event_key", F.when(ok, S.prompt_of(F.col("lines"))).alias("input"), F.when(ok, F.col("summary")).alias("output"))


def undone(clusters: DataFrame, done: DataFrame) -> DataFrame:
    """The events (event, id) that no record in done (event_key) covers, by the key of their posts."""
    keyed = clusters.groupBy("event").agg(event_key(F.collect_set("id")).alias("event_key"))
    return keyed.join(done.select("event_key"), "event_key", "left_anti")
