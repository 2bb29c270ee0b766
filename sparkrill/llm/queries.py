"""The training-data queries and, where SQL can state them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrill.llm import sql
from sparkrill.llm.byte_bpe import encoded
from sparkrill.llm.confusables import affected_fields, consistent_texts, fields_of, look_alike_groups
from sparkrill.llm.contributor_cap import dropped_posts
from sparkrill.llm.group_split import account_members, post_splits
from sparkrill.llm.history_dedup import repeats
from sparkrill.llm.langid import fit, labelled_sample, languages, relabelled
from sparkrill.llm.lsh_forest import same_text_classes, same_text_pairs
from sparkrill.llm.mixing import mixed, reached_shares
from sparkrill.llm.residue import clean_documents, residues
from sparkrill.llm.truncation import truncated, truncation_report
from sparkrill.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(table(spark, d, "posts"), "id", "content", "fetched_at").select("id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dropped_posts(table(spark, d, "posts"), table(spark, d, "contributor_caps"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return same_text_pairs(table(spark, d, "posts"), "id", "content")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its class: work and result grow with the texts."""
    return same_text_classes(table(spark, d, "posts"), "id", "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "posts"), table(spark, d, "gold_labels"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation_report(table(spark, d, "posts"), table(spark, d, "gold_labels"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return account_members(table(spark, d, "posts"), table(spark, d, "split_targets"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return post_splits(table(spark, d, "posts"), table(spark, d, "split_targets"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, beside the targets."""
    reached = p5_splits(spark, d).groupBy("split").agg(F.count("*").alias("n_posts"), F.countDistinct("account").alias("n_accounts"))
    total = F.nullif(F.lit(table(spark, d, "posts").count()), F.lit(0))
    posts, accounts = F.coalesce("n_posts", F.lit(0)), F.coalesce("n_accounts", F.lit(0))
    return table(spark, d, "split_targets").join(reached, "split", "left").select("split", "share", posts.alias("n_posts"), accounts.alias("n_accounts"), (posts / total).alias("reached"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return affected_fields(table(spark, d, "posts"), "id", ["title", "content"])


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return consistent_texts(fields_of(table(spark, d, "posts"), "id", ["title", "content"]))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts that look the same but are written differently, by equal skeleton."""
    return look_alike_groups(fields_of(table(spark, d, "posts"), "id", ["title", "content"]))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return relabelled(table(spark, d, "posts"), table(spark, d, "post_langs"))


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every post with its language, and each segment of one language with its lines and a confidence."""
    posts = table(spark, d, "posts")
    found = languages(posts, "id", "content", fit(labelled_sample(posts, table(spark, d, "post_langs"))))
    return found.select(F.col("id").alias("post_id"), F.col("lang").alias("post_lang"), F.col("confidence").alias("post_confidence"), F.explode_outer("segments").alias("s")).select("post_id", "post_lang", "post_confidence", "s.*")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return reached_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residues(table(spark, d, "documents")).select("doc_id").distinct()


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residues(table(spark, d, "documents"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_documents(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_classes, p4_found, p4_shares, p5_found, p5_splits, p5_shares, p6_found, p6_forms, p6_groups, p7_found, p7_segments, p8_ids, p9_mix, p9_shares, p10_found, p10_kinds, p10_clean)}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": sql.P2_FOUND, "p5_found": sql.P5_FOUND}
