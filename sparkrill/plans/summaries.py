"""Injected models over posts, the event pipeline, text forms, summary checks, report tables and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrill.functions import text as T
from sparkrill.functions.vectors import norm
from sparkrill.operators import faithfulness as faith
from sparkrill.operators import hooks, pipeline, render
from sparkrill.operators import sentiment as mood
from sparkrill.operators import summaries as S
from sparkrill.plans import base, models
from sparkrill.storage import written
from sparkrill.tables import table

_TEXT = "coalesce(title, '') || '. ' || coalesce(content, '')"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return base.posts(spark, d).select("id", "source", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("content", F.lit(""))).alias("text"))


def model_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in sentiment model over all posts, with confidence, sign and sarcasm marks."""
    rows = hooks.with_sentiment(_texts(spark, d), "text", temperature=0.5)
    return rows.select("id", "label", F.round("score", 6).alias("score"), "confident", F.round("signed", 6).alias("signed"), mood.is_sarcastic(F.col("text")).alias("sarcastic"))


def _counted(words: list[str]) -> str:
    return f"sqrt(len(regexp_extract_all(lower(text), '\\b(?:{'|'.join(words)})\\b')))"


MODEL_SENTIMENT = f"""
WITH t AS (SELECT id, {_TEXT} AS text FROM posts), l AS (SELECT id, text, {_counted(hooks.GOOD)} AS a, CAST(1 AS DOUBLE) AS b, {_counted(hooks.BAD)} AS c FROM t),
e AS (SELECT id, text, exp((a - greatest(a, b, c)) / 0.5) AS x, exp((b - greatest(a, b, c)) / 0.5) AS y, exp((c - greatest(a, b, c)) / 0.5) AS z FROM l), p AS (SELECT id, text, x / (x + y + z) AS x, y / (x + y + z) AS y, z / (x + y + z) AS z FROM e),
s AS (SELECT *, greatest(x, y, z) AS top, list_sort([x, y, z], 'DESC') AS r FROM p), n AS (SELECT *, CASE WHEN x = top THEN 'positive' WHEN y = top THEN 'neutral' ELSE 'negative' END AS label FROM s)
SELECT id, label, round(top, 6) AS score, r[1] >= 0.5 AND r[1] - r[2] >= 0.1 AS confident, round(CASE label WHEN 'positive' THEN top WHEN 'negative' THEN -top ELSE 0 END, 6) AS signed, regexp_matches(text, '(?i)(/s\\b|\\boh\\s+great\\s+another\\b|\\bwow,?\\s+just\\s+wow\\b|\\bwhat\\s+a\\s+surprise\\b)') AS sarcastic FROM n
"""


def model_theme(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in theme model over all posts: theme, confidence, and a second theme where it is likely too."""
    rows = hooks.with_theme(_texts(spark, d), "text", base.THEMES)
    return rows.select("id", "theme.label", F.round("theme.confidence", 6).alias("confidence"), "theme.confident", "theme.secondary")


_SCORES = ", ".join("{'score': " + (f"least(0.9::DOUBLE, 0.3::DOUBLE * ({' + '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})::INTEGER' for w in words)}))" if words else "0::DOUBLE") + f", 'name': '{name}'}}" for name, words in zip(base.THEMES, hooks.KEYWORDS))
MODEL_THEME = f"""
WITH t AS (SELECT id, {_TEXT} AS text FROM posts), s AS (SELECT id, list_sort([{_SCORES}], 'DESC') AS r FROM t)
SELECT id, CASE WHEN r[1].score >= 0.45 THEN r[1].name ELSE '其他' END AS label, round(r[1].score, 6) AS confidence, r[1].score >= 0.45 AS confident, CASE WHEN r[1].score >= 0.45 AND r[2].score >= 0.4 THEN r[2].name END AS secondary FROM s
"""


def model_entailment(spark: SparkSession, d: str) -> DataFrame:
    """By source, how many posts have a title all of whose words stand in the content, by the stand-in entailment model."""
    rows = hooks.with_entailment(base.posts(spark, d).select("source", "title", "content"), "content", "title")
    return rows.groupBy("source").agg(F.count_if(F.col("entailment") == 1).alias("entailed"), F.count("*").alias("n"))


MODEL_ENTAILMENT = """
WITH w AS (SELECT source, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+')) AS h, list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}]+')) AS p FROM posts)
SELECT source, count(*) FILTER (WHERE len(h) > 0 AND len(list_intersect(h, p)) = len(h)) AS entailed, count(*) AS n FROM w GROUP BY source
"""


def model_generated(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in generator on a prompt of two sources for each release: its title and kind."""
    rows = table(spark, d, "release_events").select("id", S.prompt_of(F.concat(F.lit("[1] "), F.coalesce("title", F.lit("none")), F.lit("\n[2] "), F.coalesce("kind", F.lit("none")))).alias("prompt"))
    return hooks.with_generated(rows, "prompt", "raw").select("id", S.parse_summary(F.col("raw")).alias("summary"))


MODEL_GENERATED = "SELECT id, regexp_replace(coalesce(title, 'none'), '[.。!！?？ ]+$', '') || ' [1].' || chr(10) || regexp_replace(coalesce(kind, 'none'), '[.。!！?？ ]+$', '') || ' [2].' AS summary FROM release_events"


def _week(spark: SparkSession, d: str) -> DataFrame:
    as_of = base.newest(base.posts(spark, d), "fetched_at")
    rows = base.gated(spark, d).filter((F.col("posted_at") >= base.moment(as_of, 7)) & (F.length("content") >= 80)).select("id", "title", "content", "url", "source")
    label = base.themes(spark, d).groupBy(F.col("post_id").alias("id")).agg(F.min(base.theme_name()).alias("theme"))
    return written(rows.join(label, "id", "left"), "week")


def _summaries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    posts = _week(spark, d)
    events, _ = pipeline.clustered(posts, "content", threshold=0.9)
    sentences = written(pipeline.key_sentences(events, posts, "content", k=4), "key-sentences")
    return posts, events, sentences, written(pipeline.summarised(sentences), "summaries")


def event_records(spark: SparkSession, d: str) -> DataFrame:
    """The last week's events of at least two alike posts, summarised from their key sentences with citations, in the served shape."""
    posts, events, sentences, summaries = _summaries(spark, d)
    return pipeline.records(summaries, sentences, events, posts)


def silver_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The same events as training records, with the gate that stopped each of them."""
    _, _, sentences, summaries = _summaries(spark, d)
    return pipeline.distilled(summaries, sentences).select("event", "status", "event_key", F.length("input").alias("input_length"), F.length("output").alias("output_length"))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Titles of all posts in their forms for display: spaced, shortened, in simplified characters, and with content where there is no title."""
    title = F.coalesce("title", F.lit(""))
    rows = base.posts(spark, d).select("id", T.pangu_spacing(title).alias("spaced"), T.make_title(title).alias("short"), T.to_simplified(title).alias("simplified"), T.to_traditional(title).alias("traditional"), T.first_filled(F.col("title"), F.col("author"), F.col("source")).alias("shown"))
    return rows


TEXT_FORMS = f"""
WITH t AS (SELECT id, coalesce(title, '') AS t, title, author, source FROM posts), f AS (SELECT *, regexp_extract(trim(t, ' '), '^([^。！？!?]*)', 1) AS first FROM t)
SELECT id, regexp_replace(regexp_replace(t, '([\\x{{4e00}}-\\x{{9fff}}])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([\\x{{4e00}}-\\x{{9fff}}])', '\\1 \\2', 'g') AS spaced, CASE WHEN length(first) > 24 THEN substring(first, 1, 24) || '…' ELSE first END AS short,
  translate(t, '{T.TRADITIONAL}', '{T.TO_SIMPLIFIED}') AS simplified, translate(t, '{T.TO_SIMPLIFIED}', '{T.TRADITIONAL}') AS traditional, coalesce(nullif(trim(title, ' '), ''), nullif(trim(author, ' '), ''), nullif(trim(source, ' '), '')) AS shown FROM f
"""


def event_keys(spark: SparkSession, d: str) -> DataFrame:
    """For each model the key of its releases, whatever their order, and the number that stands for it."""
    rows = table(spark, d, "release_events").filter("model_id is not null").groupBy("model_id").agg(F.collect_set("id").alias("ids"))
    keyed = rows.select("model_id", T.event_key(F.col("ids")).alias("key"))
    return keyed.withColumn("number", S.event_number(F.col("key")))


EVENT_KEYS = """
WITH k AS (SELECT model_id, substring(sha1(array_to_string(list_sort(list_distinct(list(CAST(id AS VARCHAR)))), '␟')), 1, 16) AS key FROM release_events WHERE model_id IS NOT NULL GROUP BY model_id)
SELECT model_id, key, -list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) - 1 AS number FROM k
"""


def cited_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's cited numbers in order, repeated ones too, and its length without them."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", S.extract_ids(F.col("text")).alias("ids"), F.length(T.strip_citations(F.col("text"))).alias("bare_length")).filter(F.size("ids") > 0)


CITED_IDS = """
WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '[\\[［]\\s*(\\d+(?:\\s*[,，、]\\s*\\d+)*)\\s*[\\]］]', 1) AS m FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_transform(flatten(list_transform(m, lambda x: regexp_extract_all(x, '\\d+'))), lambda n: CAST(n AS INTEGER)) AS ids, length(trim(regexp_replace(regexp_replace(text, '\\[\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\]', '', 'g'), '[ \\t]+', ' ', 'g'), ' ')) AS bare_length FROM m WHERE len(m) > 0
"""


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """A summary of two sentences for each post with a title, of which the second cites what may not be there."""
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"[^A-Za-z ]", "")
    return base.posts(spark, d).select("id", F.concat(title, F.when(F.col("id") % 3 != 0, " [1]").otherwise(""), F.lit("。Then more ["), (F.col("id") % 4).cast("string"), F.lit("]。")).alias("summary"), (1 + F.col("id") % 3).cast("int").alias("n_sources"))


_CITED = "SELECT id, trim(regexp_replace(coalesce(title, ''), '[^A-Za-z ]', '', 'g'), ' ') AS first, id % 3 <> 0 AS cites, id % 4 AS k, 1 + id % 3 AS n FROM posts"


def citation_checks(spark: SparkSession, d: str) -> DataFrame:
    """The form of each summary: sentences, those without a citation, numbers out of range, the share of valid sentences and the coverage of the sources."""
    rows = S.citation_validity(S.validated(_cited(spark, d), "summary", "n_sources"), "summary", "n_sources")
    return rows.select("id", "issues.ok", "issues.empty", F.size("issues.uncited_sentences").alias("uncited"), F.size("issues.out_of_range_ids").alias("out_of_range"), F.round("validity.rate", 6).alias("rate"), "validity.n_sentences", F.round("validity.coverage", 6).alias("coverage"))


CITATION_CHECKS = f"""
WITH c AS ({_CITED}), s AS (SELECT *, first <> '' OR cites AS has_first, k BETWEEN 1 AND n AS inside FROM c)
SELECT id, NOT (first <> '' AND NOT cites) AND inside AS ok, false AS empty, CAST(first <> '' AND NOT cites AS INTEGER) AS uncited, CAST(NOT inside AS INTEGER) AS out_of_range,
  round((CAST(has_first AND cites AS INTEGER) + CAST(inside AS INTEGER)) / (1 + CAST(has_first AS INTEGER)), 6) AS rate, 1 + CAST(has_first AS INTEGER) AS n_sentences, round((CASE WHEN has_first AND cites THEN 1 ELSE 0 END + CASE WHEN inside AND NOT (k = 1 AND has_first AND cites) THEN 1 ELSE 0 END) / n, 6) AS coverage FROM s
"""


def faithfulness_checks(spark: SparkSession, d: str) -> DataFrame:
    """How well each summary of two sentences is held by its sources, by the stand-in entailment model: shares of sentences, citations and sources, and the score."""
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"[^A-Za-z ]", "")
    clean = base.posts(spark, d).select("id", title.alias("t"))
    rows = _cited(spark, d).join(clean, "id").select("id", "summary", F.transform(F.sequence(F.lit(1), F.col("n_sources")), lambda i: F.when(i == 1, F.col("t")).otherwise("then more words")).alias("sources"))
    judged = hooks.with_entailment(faith.sentences(rows), "premise", "hypothesis")
    found = faith.report(judged, rows.select("id", F.size("sources").alias("n_sources")))
    return found.select("id", "n", *[F.round(c, 6).alias(c) for c in ("entailed", "validity", "coverage", "score")])


FAITHFULNESS = f"""
WITH c AS ({_CITED}), t AS (SELECT *, list_contains(string_split(lower(first), ' '), 'then') AND list_contains(string_split(lower(first), ' '), 'more') AS titled, first <> '' OR cites AS has_first, k BETWEEN 1 AND n AS inside FROM c),
e AS (SELECT *, 1 + CAST(has_first AS INTEGER) AS m, CAST(has_first AND trim(first, ' ') <> '' AS INTEGER) + CAST(CASE WHEN inside AND k = 1 THEN titled WHEN inside THEN true ELSE n >= 2 OR titled END AS INTEGER) AS ent,
  (CAST(cites AS INTEGER) + CAST(inside AS INTEGER)) / (CAST(cites AS INTEGER) + 1) AS validity, (CASE WHEN cites THEN 1 ELSE 0 END + CASE WHEN inside AND NOT (k = 1 AND cites) THEN 1 ELSE 0 END) / n AS coverage FROM t)
SELECT id, m AS n, round(ent / m, 6) AS entailed, round(validity, 6) AS validity, round(coverage, 6) AS coverage, round(0.5 * ent / m + 0.2 * validity + 0.15 * coverage + 0.15, 6) AS score FROM e
"""


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in embedding of each title: how many dimensions it fills, the largest of them and its length."""
    text = F.regexp_replace(F.coalesce("title", F.lit("")), "[^A-Za-z0-9 ]", " ")
    rows = hooks.with_vectors(base.posts(spark, d).select("id", text.alias("text")), "text")
    return rows.select("id", F.size(F.filter("v", lambda x: x > 0)).alias("filled"), F.round(F.array_max("v"), 6).alias("largest"), F.round(norm(F.col("v")), 6).alias("length"))


HASHED_VECTORS = """
WITH w AS (SELECT id, unnest(regexp_extract_all(lower(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9 ]', ' ', 'g')), '[a-z0-9]+')) AS w FROM posts), c AS (SELECT id, CAST(('0x' || right(md5(w), 2)) AS INTEGER) % 64 AS k, count(*) AS n FROM w GROUP BY 1, 2),
f AS (SELECT id, CAST(count(*) AS INTEGER) AS filled, round(max(n) / sqrt(sum(n * n)), 6) AS largest FROM c GROUP BY id) SELECT p.id, coalesce(filled, 0) AS filled, coalesce(largest, 0.0) AS largest, CASE WHEN filled > 0 THEN 1.0 ELSE 0.0 END AS length FROM posts p LEFT JOIN f ON f.id = p.id
"""


def gate_statuses(spark: SparkSession, d: str) -> DataFrame:
    """How many posts would stop at each gate on the way to a training record."""
    checked = S.validated(_cited(spark, d), "summary", "n_sources")
    rows = checked.withColumns({"n_sentences": (F.col("id") % 5).cast("int"), "faithfulness_score": F.when(F.col("id") % 7 != 0, (F.col("id") % 10) / 10), "post_ids": F.array("id")})
    return S.gated_records(rows).groupBy("status").agg(F.count("*").alias("n"), F.min("event_key").alias("first_key"))


GATE_STATUSES = f"""
WITH c AS ({_CITED}), s AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'no_key_sentences' WHEN NOT (NOT (first <> '' AND NOT cites) AND k BETWEEN 1 AND n) THEN 'format_issues' WHEN id % 7 <> 0 AND (id % 10) / 10 < 0.5 THEN 'low_faithfulness' ELSE 'ok' END AS status FROM c)
SELECT status, count(*) AS n, min(substring(sha1(CAST(id AS VARCHAR)), 1, 16)) AS first_key FROM s GROUP BY status
"""


def source_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The releases of each model as sentences of an event: the number of each one's source, by its first sentence."""
    rows = table(spark, d, "release_events").filter("model_id is not null")
    placed = rows.select(F.col("model_id").alias("event"), F.col("id").cast("int").alias("pos"), F.when(F.col("id") % 4 != 0, F.col("id") % 7).alias("post_id"))
    return S.numbered_sources(placed).select("event", "pos", "source_id")


SOURCE_NUMBERS = """
WITH s AS (SELECT model_id AS event, CAST(id AS INTEGER) AS pos, CASE WHEN id % 4 <> 0 THEN 'p' || (id % 7) ELSE 's' || id END AS k FROM release_events WHERE model_id IS NOT NULL), f AS (SELECT event, k, row_number() OVER (PARTITION BY event ORDER BY min(pos)) AS source_id FROM s GROUP BY event, k)
SELECT s.event, s.pos, f.source_id FROM s JOIN f ON f.event = s.event AND f.k = s.k
"""


def source_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The numbered lines that a prompt on each model's releases would show, as their length and digest."""
    rows = table(spark, d, "release_events").filter("model_id is not null and title is not null").select(F.col("model_id").alias("event"), F.col("id").alias("pos"), F.col("title").alias("text"))
    return S.source_block(rows).select("event", F.length("sources").alias("length"), F.md5("sources").alias("digest"))


SOURCE_BLOCKS = "WITH s AS (SELECT model_id AS event, id, '[' || row_number() OVER (PARTITION BY model_id ORDER BY id) || '] ' || replace(trim(title, ' '), chr(10), ' ') AS line FROM release_events WHERE model_id IS NOT NULL AND title IS NOT NULL) SELECT event, length(string_agg(line, chr(10) ORDER BY id)) AS length, md5(string_agg(line, chr(10) ORDER BY id)) AS digest FROM s GROUP BY event"


def label_words(spark: SparkSession, d: str) -> DataFrame:
    """For each label record the sentiment that its text names first, and the labels of pressed keys."""
    rows = table(spark, d, "gold_labels")
    names = {"good": "positive", "great": "positive", "bad": "negative", "slow": "negative", "model": "neutral"}
    key = F.element_at(F.array(*map(F.lit, ["1", " 2", "3", "x"])), (F.col("post_id") % 4 + 1).cast("int"))
    letter = F.element_at(F.array(*map(F.lit, ["T", "m", "u", "r", "e", "o", "?"])), (F.col("post_id") % 7 + 1).cast("int"))
    named = rows.select(S.first_match(F.col("text"), names).alias("named"), T.label_of_key(key, "sentiment").alias("pressed"), T.label_of_key(letter, "theme").alias("theme"))
    return named.groupBy("named", "pressed", "theme").agg(F.count("*").alias("n"))


LABEL_WORDS = """
WITH t AS (SELECT post_id, lower(coalesce(text, '')) AS t FROM gold_labels), w(k, key, label) AS (VALUES (0, 'good', 'positive'), (1, 'great', 'positive'), (2, 'bad', 'negative'), (3, 'slow', 'negative'), (4, 'model', 'neutral')),
r AS (SELECT post_id, list_filter([{'at': position('good' IN t), 'k': 0, 'label': 'positive'}, {'at': position('great' IN t), 'k': 1, 'label': 'positive'}, {'at': position('bad' IN t), 'k': 2, 'label': 'negative'}, {'at': position('slow' IN t), 'k': 3, 'label': 'negative'}, {'at': position('model' IN t), 'k': 4, 'label': 'neutral'}], lambda x: x.at > 0) AS f FROM t)
SELECT list_sort(f)[1].label AS named, CASE post_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END AS pressed, CASE post_id % 7 WHEN 0 THEN '新工具' WHEN 1 THEN '模型動態' WHEN 2 THEN '使用方法' WHEN 3 THEN '風險限制' WHEN 4 THEN '倫理法規' WHEN 5 THEN '其他' END AS theme, count(*) AS n FROM r GROUP BY 1, 2, 3
"""


def mood_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each model's index with its label and word."""
    rows = models.dashboard(spark, d).select("slug", "index")
    return rows.select("slug", mood.index_label(F.col("index")).alias("label"), F.when(F.col("index").isNotNull(), mood.mood_word(F.col("index"))).alias("word"))


MOOD_LABELS = f"SELECT slug, CASE WHEN index > 10 THEN 'positive' WHEN index < -10 THEN 'negative' ELSE 'neutral' END AS label, CASE WHEN index >= 30 THEN 'very positive' WHEN index >= 10 THEN 'positive' WHEN index > -10 THEN 'neutral' WHEN index > -30 THEN 'negative' WHEN index IS NOT NULL THEN 'very negative' END AS word FROM ({models.DASHBOARD})"


def confidences(spark: SparkSession, d: str) -> DataFrame:
    """The confidence of each stored label in its own probabilities, 1 where there are none."""
    from sparkrill.operators.evaluation import confidence_of

    named = F.create_map(F.lit("positive"), F.col("p_positive"), F.lit("neutral"), F.col("p_neutral"), F.lit("negative"), F.col("p_negative"))
    rows = base.sentiments(spark, d).withColumn("probs", F.when(F.col("p_positive").isNotNull(), named))
    return rows.select("post_id", F.round(confidence_of("label", "probs"), 9).alias("confidence"))


CONFIDENCES = f"WITH {base.SQL_SENT} SELECT post_id, round(CASE WHEN p_positive IS NULL THEN 1.0 ELSE coalesce(CASE label WHEN 'positive' THEN p_positive WHEN 'neutral' THEN p_neutral WHEN 'negative' THEN p_negative END, greatest(p_positive, p_neutral, p_negative)) END, 9) AS confidence FROM sent"


def report_shares(spark: SparkSession, d: str) -> DataFrame:
    """The report's tables of sources, themes and years: count, share as text, and a bar."""
    posts = base.posts(spark, d)
    parts = [
        posts.groupBy(F.lit("source").alias("section"), F.col("source").alias("label")).agg(F.count("*").alias("n")),
        base.themes(spark, d).groupBy(F.lit("theme").alias("section"), base.theme_name().alias("label")).agg(F.count("*").alias("n")),
        posts.groupBy(F.lit("year").alias("section"), F.year("posted_at").cast("string").alias("label")).agg(F.count("*").alias("n")),
        posts.groupBy(F.lit("duplicate").alias("section"), F.coalesce(F.array_contains("quality_flags", "DUPLICATE"), F.lit(False)).cast("string").alias("label")).agg(F.count("*").alias("n")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    total = F.sum("n").over(W.partitionBy("section"))
    return rows.select("section", "label", "n", T.percent(F.col("n"), total).alias("share"), T.bar(F.col("n") / total).alias("bar"))


REPORT_SHARES = f"""
WITH {base.SQL_THEMES}, r AS (SELECT 'source' AS section, source AS label, count(*) AS n FROM posts GROUP BY 2 UNION ALL SELECT 'theme', {base.SQL_THEME_NAME} AS l, count(*) FROM th GROUP BY 2 UNION ALL SELECT 'year', CAST(year(posted_at) AS VARCHAR), count(*) FROM posts GROUP BY 2
UNION ALL SELECT 'duplicate', CAST(coalesce(list_contains(quality_flags, 'DUPLICATE'), false) AS VARCHAR), count(*) FROM posts GROUP BY 2), t AS (SELECT *, sum(n) OVER (PARTITION BY section) AS total FROM r)
SELECT section, label, n, printf('%.1f%%', 100 * n / total) AS share, repeat('█', CAST(round_even(n / total * 20, 0) AS INTEGER)) || repeat('·', 20 - CAST(round_even(n / total * 20, 0) AS INTEGER)) AS bar FROM t
"""


def themes_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Each source's most frequent theme and its share."""
    rows = base.posts(spark, d).select(F.col("id").alias("post_id"), "source").join(base.themes(spark, d).select("post_id", base.theme_name().alias("theme")), "post_id")
    counts = rows.groupBy("source", "theme").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.max_by("theme", F.struct("n", "theme")).alias("theme"), F.round(F.max("n") / F.sum("n"), 9).alias("share"))


THEMES_BY_SOURCE = f"WITH {base.SQL_THEMES}, c AS (SELECT p.source, {base.SQL_THEME_NAME.replace('label', 't.label')} AS theme, count(*) AS n FROM posts p JOIN th t ON t.post_id = p.id GROUP BY 1, 2) SELECT source, arg_max(theme, (n, theme)) AS theme, round(max(n) / sum(n), 9) AS share FROM c GROUP BY source"


def report_findings(spark: SparkSession, d: str) -> DataFrame:
    """What stands out in the corpus, a row for each finding: the largest source, the most negative one, and the shares of good, unchecked and duplicate posts."""
    posts = base.posts(spark, d)
    total = posts.agg(F.count("*").alias("total"), F.count_if(F.col("quality_score") >= 70).alias("good"), F.count_if(F.col("quality_score").isNull()).alias("unchecked"), F.count_if(F.coalesce(F.array_contains("quality_flags", "DUPLICATE"), F.lit(False))).alias("duplicates"))
    shares = total.select(F.explode(F.array(*[F.struct(F.lit(name).alias("finding"), F.lit("").alias("subject"), (F.col(c) / F.col("total")).alias("share")) for name, c in (("good", "good"), ("unchecked", "unchecked"), ("duplicates", "duplicates"))])).alias("f")).select("f.*")
    sizes = posts.groupBy("source").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.lit("largest source").alias("finding"), F.max_by("source", F.struct("n", "source")).alias("subject"), (F.max("n") / F.sum("n")).alias("share"))
    moods = posts.select(F.col("id").alias("post_id"), "source").join(base.sentiments(spark, d).select("post_id", "label"), "post_id").groupBy("source").agg(F.avg((F.col("label") == "negative").cast("double")).alias("bad"))
    worst = moods.agg(F.lit("most negative source").alias("finding"), F.max_by("source", F.struct("bad", "source")).alias("subject"), F.max("bad").alias("share"))
    return largest.unionByName(worst).unionByName(shares).withColumn("share", F.round("share", 9))


REPORT_FINDINGS = f"""
WITH {base.SQL_SENT}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE quality_score >= 70) AS good, count(*) FILTER (WHERE quality_score IS NULL) AS unchecked, count(*) FILTER (WHERE coalesce(list_contains(quality_flags, 'DUPLICATE'), false)) AS dups FROM posts),
s AS (SELECT source, count(*) AS n FROM posts GROUP BY source), m AS (SELECT p.source, avg(CAST(s.label = 'negative' AS INTEGER)) AS bad FROM posts p JOIN sent s ON s.post_id = p.id GROUP BY 1)
SELECT 'largest source' AS finding, arg_max(source, (n, source)) AS subject, round(max(n) / sum(n), 9) AS share FROM s UNION ALL SELECT 'most negative source', arg_max(source, (bad, source)), round(max(bad), 9) FROM m
UNION ALL SELECT 'good', '', round(good / total, 9) FROM t UNION ALL SELECT 'unchecked', '', round(unchecked / total, 9) FROM t UNION ALL SELECT 'duplicates', '', round(dups / total, 9) FROM t
"""


def relative_times(spark: SparkSession, d: str) -> DataFrame:
    """How long ago each post was, in the largest whole unit, at the time of the last fetch."""
    as_of = base.moment(base.newest(base.posts(spark, d), "fetched_at"))
    return base.posts(spark, d).filter("posted_at is not null").select("id", render.relative_time(F.col("posted_at"), as_of).alias("ago"))


RELATIVE_TIMES = """
WITH s AS (SELECT id, CAST(floor(epoch(posted_at) - epoch((SELECT max(fetched_at) FROM posts)) + 0.5) AS BIGINT) AS s FROM posts WHERE posted_at IS NOT NULL),
u AS (SELECT *, CASE WHEN abs(s) >= 86400 THEN 86400 WHEN abs(s) >= 3600 THEN 3600 WHEN abs(s) >= 60 THEN 60 ELSE 1 END AS k FROM s)
SELECT id, CAST(floor(s / k + 0.5) AS BIGINT) || ' ' || CASE k WHEN 86400 THEN 'day' WHEN 3600 THEN 'hour' WHEN 60 THEN 'minute' ELSE 'second' END AS ago FROM u
"""


def comparison_text(spark: SparkSession, d: str) -> DataFrame:
    """The comparison of three models as text, one row: a line for each, and the advice."""
    rows = models.compare_recommend(spark, d)
    line = F.concat(F.lit("- "), "slug", F.lit(": "), F.coalesce(F.format_string("%+d", "index"), F.lit("-")), F.lit(", "), F.col("n_posts").cast("string"), F.lit(" posts, "), F.col("n_recent").cast("string"), F.lit(" lately"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slug", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.agg(F.concat(lines, F.lit("\nAdvice: "), F.coalesce(F.max(F.when(F.col("recommended"), F.col("slug"))), F.lit("none"))).alias("text"))


COMPARISON_TEXT = f"WITH c AS ({models.COMPARE}) SELECT string_agg('- ' || slug || ': ' || coalesce(printf('%+d', index), '-') || ', ' || n_posts || ' posts, ' || n_recent || ' lately', chr(10) ORDER BY slug) || chr(10) || 'Advice: ' || coalesce(max(CASE WHEN recommended THEN slug END), 'none') AS text FROM c"


def knowledge_lines(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge pack of all gated posts: numbered lines by theme, as their count and total length."""
    label = base.themes(spark, d).groupBy(F.col("post_id").alias("id")).agg(F.min("label").alias("theme"))
    rows = base.gated(spark, d).select("id", "title", "source", "url").join(label, "id")
    return S.knowledge_pack(rows, base.THEMES).groupBy("theme").agg(F.count("*").alias("n"), F.max("n").alias("last"), F.sum(F.length("line")).alias("length"))


KNOWLEDGE_LINES = f"""
WITH {base.SQL_GATED}, {base.SQL_THEMES}, l AS (SELECT post_id, min(label) AS label FROM th GROUP BY 1),
r AS (SELECT g.id, CASE WHEN label IN ('模型動態', '新工具', '使用方法', '風險限制', '倫理法規') THEN label ELSE '其他' END AS theme, title, source, url FROM gated g JOIN l ON l.post_id = g.id), n AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY id) AS k FROM r)
SELECT theme, count(*) AS n, max(k) AS last, CAST(sum(length('- **' || coalesce(nullif(trim(title, ' '), ''), '(untitled)') || '**' || CASE WHEN coalesce(source, '') <> '' THEN '（' || source || '）' ELSE '' END || ' [' || k || ']' || CASE WHEN coalesce(url, '') <> '' THEN chr(10) || '  - ' || url ELSE '' END)) AS BIGINT) AS length FROM n GROUP BY theme
"""

QUERIES = {
    "model_sentiment": (model_sentiment, MODEL_SENTIMENT),
    "model_theme": (model_theme, MODEL_THEME),
    "model_entailment": (model_entailment, MODEL_ENTAILMENT),
    "model_generated": (model_generated, MODEL_GENERATED),
    "event_records": (event_records, None),
    "silver_summaries": (silver_summaries, None),
    "text_forms": (text_forms, TEXT_FORMS),
    "event_keys": (event_keys, EVENT_KEYS),
    "cited_ids": (cited_ids, CITED_IDS),
    "citation_checks": (citation_checks, CITATION_CHECKS),
    "faithfulness_checks": (faithfulness_checks, FAITHFULNESS),
    "hashed_vectors": (hashed_vectors, HASHED_VECTORS),
    "gate_statuses": (gate_statuses, GATE_STATUSES),
    "source_numbers": (source_numbers, SOURCE_NUMBERS),
    "source_blocks": (source_blocks, SOURCE_BLOCKS),
    "label_words": (label_words, LABEL_WORDS),
    "mood_labels": (mood_labels, MOOD_LABELS),
    "confidences": (confidences, CONFIDENCES),
    "report_shares": (report_shares, REPORT_SHARES),
    "themes_by_source": (themes_by_source, THEMES_BY_SOURCE),
    "report_findings": (report_findings, REPORT_FINDINGS),
    "relative_times": (relative_times, RELATIVE_TIMES),
    "comparison_text": (comparison_text, COMPARISON_TEXT),
    "knowledge_lines": (knowledge_lines, KNOWLEDGE_LINES),
}
