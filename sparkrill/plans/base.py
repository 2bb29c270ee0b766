"""The logical relations that the plans share, as DataFrames and as SQL text for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrill.tables import table

QUALITY_MIN = 30
QUALITY_HIGH = 60
# The themes in their order, and a name that old rows still carry.
THEMES = ["模型動態", "新工具", "使用方法", "風險限制", "倫理法規", "其他"]
LEGACY_THEME = {"邊界": "風險限制"}


def gate(score: str = "quality_score", flags: str = "quality_flags") -> Column:
    """The quality gate of everything that is counted: unchecked or good enough, and no duplicate."""
    return (F.col(score).isNull() | (F.col(score) >= QUALITY_MIN)) & ~F.coalesce(F.array_contains(F.col(flags), "DUPLICATE"), F.lit(False))


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts")


def gated(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).filter(gate())


def models(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "models")


def bridge(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Rows of df for each known model they name, with slug and model_id; unknown slugs drop out. models is a fixed dimension of a few rows."""
    dim = models(spark, d).select(F.col("id").alias("model_id"), "slug")
    return df.withColumn("slug", F.explode(F.array_distinct("models"))).join(F.broadcast(dim), "slug")


def sentiments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentiments").dropDuplicates()


def themes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "themes").dropDuplicates()


def theme_name(label: str = "label") -> Column:
    """The theme of a label: old names are mapped, unknown ones are the last theme."""
    old = F.col(label)
    for name, new in LEGACY_THEME.items():
        old = F.when(F.col(label) == name, new).otherwise(old)
    return F.when(old.isin(*THEMES), old).otherwise(THEMES[-1])


def loose_gate(score: str = "quality_score") -> Column:
    """The gate of mails and labelling queues: unchecked or good enough, duplicates too."""
    return F.col(score).isNull() | (F.col(score) >= QUALITY_MIN)


def newest(rows: DataFrame, column: str) -> int | None:
    """The largest time of a column in microseconds, read once, so that windows behind it are literals that reach the scan; null without any."""
    return rows.agg(F.unix_micros(F.max(column))).first()[0]


def moment(micros: int | None, days: float = 0) -> Column:
    """The literal time so many days before; null if there is no time."""
    return F.timestamp_micros(F.lit(None if micros is None else micros - int(days * 86_400_000_000)).cast("bigint"))


def day(column: str) -> Column:
    return F.to_date(F.col(column))


SQL_GATE = f"(quality_score IS NULL OR quality_score >= {QUALITY_MIN}) AND NOT coalesce(list_contains(quality_flags, 'DUPLICATE'), false)"
SQL_GATED = f"gated AS (SELECT * FROM posts WHERE {SQL_GATE})"
SQL_BRIDGE = "bridge AS (SELECT p.*, m.id AS model_id, m.slug FROM (SELECT *, unnest(list_distinct(models)) AS s FROM {0}) p JOIN models m ON m.slug = p.s)"
SQL_SENT = "sent AS (SELECT DISTINCT * FROM sentiments)"
SQL_THEMES = "th AS (SELECT DISTINCT * FROM themes)"
SQL_THEME_NAME = "CASE WHEN label = '邊界' THEN '風險限制' WHEN label IN ('模型動態', '新工具', '使用方法', '風險限制', '倫理法規', '其他') THEN label ELSE '其他' END"
