"""Vector similarity, clusters, key sentences and faithfulness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrill.functions import text as T
from sparkrill.operators import faithfulness as faith
from sparkrill.operators import vectors as V
from sparkrill.plans import base
from sparkrill.storage import written
from sparkrill.tables import table

THRESHOLD = 0.4


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.similar_pairs(_vectors(spark, d), THRESHOLD).select("a", "b", F.round("similarity", 5).alias("similarity"))


_E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"
_PAIRS = f"{_E}, pairs AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS similarity FROM e x JOIN e y ON x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= {THRESHOLD})"
_CLUSTERS = f"{_PAIRS}, ends AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(id, root) AS (SELECT a, a FROM ends UNION SELECT n.b, r.root FROM reach r JOIN ends n ON n.a = r.id WHERE r.root < n.b), clusters AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id)"


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """Each label's centroid, as its length and first two dimensions."""
    from sparkrill.functions.vectors import norm

    found = V.centroids(_vectors(spark, d), "label")
    return found.select("label", "n", F.round(norm(F.col("centroid")), 6).alias("length"), F.round(F.get("centroid", F.lit(0)), 6).alias("x0"), F.round(F.get("centroid", F.lit(1)), 6).alias("x1"))


CENTROIDS = f"""
WITH {_E}, c AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY 1, 2)
SELECT label, max(n) AS n, round(sqrt(sum(m * m)), 6) AS length, round(max(m) FILTER (WHERE pos = 1), 6) AS x0, round(max(m) FILTER (WHERE pos = 2), 6) AS x1 FROM c GROUP BY label
"""


def threshold_clusters(spark: SparkSession, d: str) -> DataFrame:
    return V.threshold_clusters(_vectors(spark, d).select("id", "v"), THRESHOLD)


def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return V.density_clusters(_vectors(spark, d).select("id", "v"), THRESHOLD, 3)


DENSITY = f"""
WITH RECURSIVE {_PAIRS}, ends AS (SELECT a, b, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs), dense AS (SELECT a AS id FROM ends GROUP BY a HAVING count(*) >= 3),
inner_ends AS (SELECT a, b FROM ends WHERE a IN (SELECT id FROM dense) AND b IN (SELECT id FROM dense)), reach(id, root) AS (SELECT id, id FROM dense UNION SELECT n.b, r.root FROM reach r JOIN inner_ends n ON n.a = r.id WHERE r.root < n.b), comp AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
border AS (SELECT a AS id, arg_max(b, (round(similarity, 9), -b)) AS b FROM ends WHERE b IN (SELECT id FROM dense) AND a NOT IN (SELECT id FROM dense) GROUP BY a)
SELECT e.id, coalesce(c.cluster, k.cluster, -1) AS cluster FROM e LEFT JOIN comp c ON c.id = e.id LEFT JOIN border b ON b.id = e.id LEFT JOIN comp k ON k.id = b.b
"""


def approximate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a cosine of 0.9 and more by hashed directions instead of all products."""
    return V.approximate_pairs(_vectors(spark, d), 0.9).select("a", "b", F.round("similarity", 5).alias("similarity"))


def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d).select("id", "v")
    return V.representatives(vectors, written(V.threshold_clusters(vectors, THRESHOLD), "clusters")).withColumn("similarity", F.round("similarity", 5))


REPRESENTATIVES = f"""
WITH RECURSIVE {_CLUSTERS}, cells AS (SELECT c.cluster, c.id, unnest(e.v) AS x, generate_subscripts(e.v, 1) AS pos FROM clusters c JOIN e ON e.id = c.id),
cen AS (SELECT cluster, n, list(m ORDER BY pos) AS centroid FROM (SELECT cluster, pos, avg(x) AS m, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY cluster, n),
near AS (SELECT c.cluster, cen.n, c.id, list_cosine_similarity(e.v, cen.centroid) AS similarity FROM clusters c JOIN e ON e.id = c.id JOIN cen ON cen.cluster = c.cluster)
SELECT cluster, max(n) AS n, arg_max(id, (round(similarity, 9), -id)) AS id, round(max(similarity), 5) AS similarity FROM near GROUP BY cluster
"""


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    """Five diverse members of each label."""
    return V.mmr(_vectors(spark, d), "label", 5)


def _mmr_sql(k: int, weight: float = 0.7) -> str:
    """The steps as one chain of tables: rows left with their closest chosen one, and the best of each label."""
    steps = ["r1 AS (SELECT e.id, e.label, e.v, list_cosine_similarity(e.v, c.centroid) AS relevance, CAST(0 AS DOUBLE) AS closest FROM e JOIN cen c ON c.label = e.label)"]
    for n in range(1, k + 1):
        score = f"round({weight} * relevance - {1 - weight} * closest, 9)" if n > 1 else "round(relevance, 9)"
        steps.append(f"b{n} AS (SELECT label, arg_max(id, ({score}, -id)) AS chosen, arg_max(v, ({score}, -id)) AS w FROM r{n} GROUP BY label)")
        near = "greatest(closest, list_cosine_similarity(r.v, b.w))" if n > 1 else "list_cosine_similarity(r.v, b.w)"
        steps.append(f"r{n + 1} AS (SELECT r.id, r.label, r.v, r.relevance, {near} AS closest FROM r{n} r JOIN b{n} b ON b.label = r.label WHERE r.id <> b.chosen)")
    found = " UNION ALL ".join(f"SELECT label, {n} AS place, chosen AS id FROM b{n}" for n in range(1, k + 1))
    centre = "cells AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), cen AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM cells GROUP BY 1, 2) GROUP BY label)"
    return f"WITH {_E}, {centre}, {', '.join(steps)} {found}"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """(post_id, pos, sentence, theme) of the gated posts with a theme."""
    posts = base.gated(spark, d).select("id", "content").join(base.themes(spark, d).select(F.col("post_id").alias("id"), base.theme_name().alias("theme")), "id")
    return posts.select(F.col("id").alias("post_id"), "theme", F.posexplode(T.split_sentences(F.col("content"))).alias("pos", "sentence"))


def key_sentences(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    """Each theme's k key sentences: near its centre, unlike each other; numbered from 1 as sources."""
    distinct = _sentences(spark, d).groupBy("theme", "sentence").agg(F.min("post_id").alias("post_id"))
    rows = written(V.hashed_bag(distinct.withColumn("id", F.xxhash64("theme", "sentence")), "sentence"), "sentence-vectors")
    chosen = V.mmr(rows.select("id", "v", "theme"), "theme", k)
    return chosen.join(rows.select("id", "sentence", "post_id"), "id").select("theme", F.col("place").alias("n"), "post_id", "sentence")


def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """A report on extractive summaries: each post's first two sentences, citing [1], against its whole content."""
    posts = base.gated(spark, d).filter("length(content) >= 80").select("id", F.filter(F.slice(T.split_sentences(F.col("content")), 1, 2), lambda s: F.length(s) > 0).alias("s"), "content")
    summaries = posts.select("id", F.concat(F.array_join(F.transform("s", lambda x: F.concat(F.regexp_replace(x, r"[.!?。！？]+$", ""), F.lit(" [1]"))), "。")).alias("summary"), F.array("content").alias("sources"))
    parts = faith.sentences(summaries).withColumn("entailment", faith.word_overlap(F.col("premise"), F.col("hypothesis"))).withColumn("contradiction", F.lit(0.0))
    return faith.report(parts, summaries.select("id", F.size("sources").alias("n_sources")))


QUERIES = {
    "cosine_pairs": (cosine_pairs, f"WITH {_PAIRS} SELECT a, b, round(similarity, 5) AS similarity FROM pairs"),
    "density_clusters": (density_clusters, DENSITY),
    "approximate_pairs": (approximate_pairs, None),
    "centroids": (centroids, CENTROIDS),
    "threshold_clusters": (threshold_clusters, f"WITH RECURSIVE {_CLUSTERS} SELECT id, cluster FROM clusters"),
    "cluster_representatives": (cluster_representatives, REPRESENTATIVES),
    "mmr_select": (mmr_select, _mmr_sql(5)),
    "key_sentences": (key_sentences, None),
    "faithfulness_score": (faithfulness, None),
}
