"""Text predicates, quality flags, duplicates, trending terms, sentences and citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrill.functions import text as T
from sparkrill.operators import duplicates as dup
from sparkrill.operators.quality import scored
from sparkrill.operators.trending import trending
from sparkrill.plans import base
from sparkrill.plans.quality_sql import DQ_SCORES
from sparkrill.storage import spread, written
from sparkrill.tables import table


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return base.posts(spark, d).select("id", "source", "posted_at", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("content", F.lit(""))).alias("text"))


_TEXT = "coalesce(title, '') || '. ' || coalesce(content, '')"


def match_models(spark: SparkSession, d: str) -> DataFrame:
    """The models each post names in title or content."""
    return _whole(spark, d).select("id", T.match_models(F.col("text")).alias("slugs"))


_NAMED = ", ".join(f"CASE WHEN regexp_matches(text, '{T.alias_pattern(s)}') THEN '{s}' END" for s in T.ALIASES)
MATCH_MODELS = f"SELECT id, list_filter([{_NAMED}], lambda x: x IS NOT NULL) AS slugs FROM (SELECT id, {_TEXT} AS text FROM posts)"


def text_traits(spark: SparkSession, d: str) -> DataFrame:
    """Script and topic traits of each post: share of Chinese characters, simplified or not, needing translation."""
    text = F.col("text")
    return _whole(spark, d).select("id", F.round(T.cjk_ratio(text), 6).alias("cjk_ratio"), T.looks_simplified(text).alias("simplified"), T.needs_translation(text).alias("translate"))


TEXT_TRAITS = f"""
WITH t AS (SELECT id, text, length(text) AS n, length(text) - length(regexp_replace(text, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS c, length(text) - length(regexp_replace(text, '[{T.SIMPLIFIED}]', '', 'g')) AS s FROM (SELECT id, {_TEXT} AS text FROM posts))
SELECT id, round(c / n, 6) AS cjk_ratio, s >= 2 AS simplified, length(trim(text, ' ')) >= 3 AND c / n < 0.15 AS translate FROM t
"""


def ai_related(spark: SparkSession, d: str) -> DataFrame:
    """Posts about AI in the wide sense, by source."""
    return _whole(spark, d).groupBy("source").agg(F.count_if(T.is_ai_related(F.col("text"))).alias("n_ai"), F.count("*").alias("n"))


# DuckDB's patterns have no lookaround: the boundary is matched instead.
AI_RELATED = f"""
SELECT source, count(*) FILTER (WHERE regexp_matches(lower(text), '(^|[^a-z])(({"|".join(T.AI_STRICT)})([^a-z]|$)|({"|".join(T.AI_LOOSE)}))') OR regexp_matches(text, '{"|".join(T.AI_ZH)}')) AS n_ai, count(*) AS n FROM (SELECT source, {_TEXT} AS text FROM posts) GROUP BY source
"""


def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return base.posts(spark, d).select("id", T.canonical_url(F.col("url")).alias("canonical")).filter("canonical is not null")


_PARAMS = "list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT list_contains([" + ", ".join(f"'{t}'" for t in T.TRACKING) + "], lower(string_split(p, '=')[1])))"
_CANONICAL = f"""
u AS (SELECT id, trim(url) AS u FROM posts WHERE trim(url) <> ''), parts AS (
  SELECT id, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', ''), ':(80|443)?$', '') AS host, regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, list_sort({_PARAMS}) AS params FROM u WHERE regexp_matches(lower(u), '^https?://')),
canonical AS (SELECT id, host || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM parts WHERE host <> '')
"""
CANONICAL_URL = f"WITH {_CANONICAL} SELECT id, canonical FROM canonical"


def url_groups(spark: SparkSession, d: str) -> DataFrame:
    """Canonical addresses of at least two posts."""
    return canonical_url(spark, d).groupBy("canonical").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def dq_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every post with its score and flags by the rules."""
    return scored(spread(base.posts(spark, d).select("id", "source", "title", "content", "author", "models"))).select("id", "quality_score", "quality_flags")


def title_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Classes of different titles with nearly the same words: representatives a < b and their similarity."""
    classes = written(dup.title_classes(base.posts(spark, d)), "title-classes")
    return dup.similar_sets(classes.filter("id = rep").select("id", "tokens")).select("a", "b", F.round("similarity", 6).alias("similarity"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '^[\\s]*(show|ask|tell)[\\s]+hn[:\\-\\s]+', ''), '[\\[(]\\s*(pdf|video|2\\d{3}|19\\d{2}|slides?|gist)\\s*[\\])]', ' ', 'g'), '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}\\x{1f130}-\\x{1f149}\\x{1f150}-\\x{1f169}\\x{1f170}-\\x{1f189}\\x{24b6}-\\x{24e9}]', ' ', 'g'), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g'))"
_TITLE_CLASSES = f"""
sets AS (SELECT id, list_sort(list_filter(list_distinct(string_split({_NORM}, ' ')), lambda t: t <> '')) AS tokens FROM posts), big AS (SELECT * FROM sets WHERE len(tokens) >= 4),
classes AS (SELECT tokens, min(id) AS rep FROM big GROUP BY tokens),
near AS (SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.tokens, y.tokens)) / (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens))) AS similarity FROM classes x JOIN classes y ON x.rep < y.rep AND least(len(x.tokens), len(y.tokens)) >= 0.8 * greatest(len(x.tokens), len(y.tokens)) - 1e-9 AND len(list_intersect(x.tokens, y.tokens)) >= 0.8 * (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens))) - 1e-9)
"""
TITLE_PAIRS = f"WITH {_TITLE_CLASSES} SELECT a, b, round(similarity, 6) AS similarity FROM near"


def near_dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every clustered post with its cluster and the post that stays."""
    posts = base.posts(spark, d)
    return dup.canonicals(posts, written(dup.clusters(posts), "clusters"))


NEAR_DUP_CLUSTERS = f"""
WITH RECURSIVE {_TITLE_CLASSES}, {_CANONICAL}, firsts AS (SELECT canonical, min(id) AS a FROM canonical GROUP BY canonical),
edges AS (SELECT a, b FROM near UNION SELECT c.rep, b.id FROM big b JOIN classes c ON c.tokens = b.tokens WHERE b.id <> c.rep UNION SELECT f.a, c.id FROM canonical c JOIN firsts f ON f.canonical = c.canonical WHERE c.id <> f.a),
ends AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(id, root) AS (SELECT a, a FROM ends UNION SELECT e.b, r.root FROM reach r JOIN ends e ON e.a = r.id WHERE r.root < e.b),
comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
best AS (SELECT c.component, arg_min(p.id, (CASE WHEN posted_at IS NULL THEN 1 ELSE 0 END, coalesce(epoch_us(posted_at), 0), -(coalesce(score, 0) + coalesce(num_comments, 0)), CASE source WHEN 'lobsters' THEN 0 WHEN 'hackernews' THEN 1 WHEN 'devto' THEN 2 WHEN 'reddit' THEN 3 WHEN 'threads' THEN 4 ELSE 99 END, p.id)) AS canonical_id FROM comp c JOIN posts p ON p.id = c.id GROUP BY 1)
SELECT c.id, c.component, b.canonical_id FROM comp c JOIN best b ON b.component = c.component
"""


def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every post's flags after reconciliation with the clusters."""
    # Only duplicates get a mark: what found them is gone before the flags of all posts are shuffled.
    picked = written(near_dup_clusters(spark, d).filter("id <> canonical_id").select("id", "canonical_id"), "picked")
    return dup.reconciled_flags(base.posts(spark, d), picked)


DUPLICATE_FLAGS = f"""
WITH picked AS ({NEAR_DUP_CLUSTERS}) SELECT p.id, list_sort(list_distinct(list_concat(list_filter(coalesce(quality_flags, []), lambda f: f <> 'DUPLICATE' AND NOT starts_with(f, 'CANONICAL:')), CASE WHEN c.canonical_id <> p.id THEN ['DUPLICATE', 'CANONICAL:' || c.canonical_id] ELSE [] END))) AS quality_flags FROM posts p LEFT JOIN picked c ON c.id = p.id
"""


def simhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dup.simhash_edges(base.posts(spark, d))


def trending_terms(spark: SparkSession, d: str) -> DataFrame:
    """The Latin terms of the last 7 days that stand out against the last 30."""
    return trending(_terms(spark, d, T.latin_terms))


def _terms(spark: SparkSession, d: str, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """(recent, term): the distinct terms of each post of the last 30 days by a tokenizer, recent where the post is of the last 7."""
    as_of = base.newest(base.posts(spark, d), "fetched_at")
    rows = base.gated(spark, d).filter(F.col("posted_at") >= base.moment(as_of, 30))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("content", F.lit("")))
    return rows.select((F.col("posted_at") >= base.moment(as_of, 7)).alias("recent"), F.explode(tokenizer(text)).alias("term"))


def trending_terms_zh(spark: SparkSession, d: str) -> DataFrame:
    """The same for Chinese: pairs of neighbouring characters, as there is no word segmentation here."""
    return trending(_terms(spark, d, T.cjk_bigrams))


_PAIRS_OF = "list_distinct(flatten(list_transform(regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda k: substring(r, k, 2)))))"


_STOP = ", ".join(f"'{w}'" for w in sorted(set(T.STOPWORDS)))
TRENDING_TERMS = f"""
WITH {base.SQL_GATED}, r AS (SELECT posted_at >= (SELECT max(fetched_at) FROM posts) - INTERVAL 7 DAYS AS recent, unnest(list_distinct(regexp_extract_all(lower({_TEXT}), '[a-z][a-z0-9]+'))) AS term FROM gated WHERE posted_at >= (SELECT max(fetched_at) FROM posts) - INTERVAL 30 DAYS),
c AS (SELECT term, count(*) FILTER (WHERE recent) AS rc, count(*) AS bc FROM r WHERE regexp_matches(term, '[a-z][0-9]*[a-z]') AND term NOT IN ({_STOP}) GROUP BY term),
t AS (SELECT *, sum(rc) OVER () AS n1, sum(bc) OVER () AS n2, 0.01 * count(*) OVER () AS np FROM c),
z AS (SELECT term, rc, (ln((rc + 0.01) / (n1 + np - rc - 0.01)) - ln((bc + 0.01) / (n2 + np - bc - 0.01))) / sqrt(1 / (rc + 0.01) + 1 / (bc + 0.01)) AS z FROM t WHERE rc >= 5)
SELECT term, round(z, 3) AS z, rc AS recent_count, row_number() OVER (ORDER BY round(z, 3) DESC, term) AS rank FROM z ORDER BY rank LIMIT 20
"""


TRENDING_ZH = TRENDING_TERMS.replace("list_distinct(regexp_extract_all(lower(" + _TEXT + "), '[a-z][a-z0-9]+'))", _PAIRS_OF.format(f"({_TEXT})")).replace(f"WHERE regexp_matches(term, '[a-z][0-9]*[a-z]') AND term NOT IN ({_STOP})", "")


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document: how many, and the longest."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", T.split_sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


_WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
SENTENCE_COUNTS = f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？.!?])', '\\1' || chr(10), 'g'), '[\\n\\r]+'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: length(x) >= 2 AND regexp_matches(x, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}]')) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INTEGER) AS longest FROM s
"""


def citations(spark: SparkSession, d: str) -> DataFrame:
    """The numbers cited in square brackets in each document that has any."""
    docs = table(spark, d, "documents").filter(F.col("text").rlike(r"\[\s*\d+(\s*,\s*\d+)*\s*\]"))
    return docs.select("doc_id", T.parse_citations(F.col("text")).alias("cited"))


CITATIONS = """
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\]')) AS m, generate_subscripts(regexp_extract_all(text, '\\[\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\]'), 1) AS k FROM documents WHERE regexp_matches(text, '\\[\\s*\\d+(\\s*,\\s*\\d+)*\\s*\\]')),
n AS (SELECT doc_id, k, unnest(regexp_extract_all(m, '\\d+')) AS n, generate_subscripts(regexp_extract_all(m, '\\d+'), 1) AS j FROM m), f AS (SELECT doc_id, CAST(n AS INTEGER) AS n, min((k, j)) AS o FROM n GROUP BY 1, 2)
SELECT doc_id, list(n ORDER BY o) AS cited FROM f GROUP BY doc_id
"""

QUERIES = {
    "match_models": (match_models, MATCH_MODELS),
    "text_traits": (text_traits, TEXT_TRAITS),
    "ai_related": (ai_related, AI_RELATED),
    "canonical_url": (canonical_url, CANONICAL_URL),
    "url_duplicate_groups": (url_groups, f"WITH {_CANONICAL} SELECT canonical, count(*) AS n, min(id) AS first_id FROM canonical GROUP BY canonical HAVING count(*) > 1"),
    "dq_score_flags": (dq_flags, DQ_SCORES),
    "title_jaccard_pairs": (title_pairs, TITLE_PAIRS),
    "simhash_title_pairs": (simhash_pairs, None),
    "near_dup_clusters": (near_dup_clusters, NEAR_DUP_CLUSTERS),
    "duplicate_flags": (duplicate_flags, DUPLICATE_FLAGS),
    "trending_terms": (trending_terms, TRENDING_TERMS),
    "trending_terms_zh": (trending_terms_zh, TRENDING_ZH),
    "sentence_split": (sentence_counts, SENTENCE_COUNTS),
    "citations": (citations, CITATIONS),
}
