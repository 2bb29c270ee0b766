"""JSON-lines files: tolerant and strict readers, the served events, and score files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrill.plans.base import THEMES

EVENT = "event_id string, title string, summary string, citations array<struct<n:string,url:string,post_id:string>>, member_count string, theme string"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a missing file is empty. Bad lines are skipped, or an error if strict."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def served_events(spark: SparkSession, path: str, limit: int = 8) -> DataFrame:
    """(id, title, summary, citations, member_count, theme) of the first `limit` usable events.

    Events without a text as summary are left out; a missing id is the line's number, an unknown theme the last theme, a citation's
    number its place where it has none.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "id string, title string, summary string, citations array<struct<n:int,url:string,post_id:string>>, member_count int, theme string")
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    numbered = lines.withColumn("_line", F.row_number().over(W.partitionBy().orderBy("_at")))
    parsed = numbered.filter(F.trim("value") != "").select("_line", F.from_json("value", EVENT).alias("r"), F.get_json_object("value", "$.summary").alias("_summary")).filter("r is not null and r.summary is not null")
    cited = F.transform(F.coalesce("r.citations", F.array().cast("array<struct<n:string,url:string,post_id:string>>")), lambda c, i: F.struct(F.coalesce(c["n"].try_cast("int"), i + 1).alias("n"), c["url"].alias("url"), c["post_id"].alias("post_id")))
    theme = F.when(F.col("r.theme").isin(*THEMES), F.col("r.theme")).otherwise(THEMES[-1])
    rows = parsed.select("_line", F.coalesce("r.event_id", F.col("_line").cast("string")).alias("id"), F.coalesce("r.title", F.lit("")).alias("title"), F.col("r.summary").alias("summary"), cited.alias("citations"), F.coalesce(F.col("r.member_count").try_cast("int"), F.lit(0)).alias("member_count"), theme.alias("theme"))
    return rows.orderBy("_line").limit(limit).drop("_line")


def score_file(spark: SparkSession, path: str, id_field: str = "event_id", score_fields: tuple[str, ...] = ("faithfulness", "faithfulness_score")) -> DataFrame:
    """(id, score): the last score of each id; rows without an id or a number are left out."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    score = F.coalesce(*[F.get_json_object("value", f"$.{f}").try_cast("double") for f in score_fields])
    rows = lines.select("_at", F.get_json_object("value", f"$.{id_field}").alias("id"), score.alias("score")).filter("id is not null and score is not null")
    return rows.groupBy("id").agg(F.max_by("score", "_at").alias("score"))
