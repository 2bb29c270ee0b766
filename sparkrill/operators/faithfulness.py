"""Whether cited summaries hold what their sources say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrill.functions.text import parse_citations, split_summary, strip_citations

ENTAILED, CONTRADICTED = 0.5, 0.5
# The weights of the score.
WEIGHTS = {"entailed": 0.50, "validity": 0.20, "coverage": 0.15, "consistent": 0.15}


def word_overlap(premise: Column, hypothesis: Column) -> Column:
    """A stand-in for an entailment model: the share of the hypothesis's words that the premise has."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(hypothesis), F.lit(r"(?U)\w+"), F.lit(0)))
    known = F.array_distinct(F.regexp_extract_all(F.lower(premise), F.lit(r"(?U)\w+"), F.lit(0)))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, known)) / F.size(words)).otherwise(F.lit(0.0))


def sentences(summaries: DataFrame) -> DataFrame:
    """(id, pos, hypothesis, premise, cited, valid) of summaries (id, summary, sources array<string>): a sentence's premise is the cited
    sources, or all of them where it cites none that exists."""
    parts = summaries.select("id", "sources", F.posexplode(split_summary(F.col("summary"))).alias("pos", "sentence"))
    cited = parse_citations(F.col("sentence"))
    rows = parts.withColumn("cited", cited).withColumn("valid", F.filter("cited", lambda i: (i >= 1) & (i <= F.size("sources"))))
    chosen = F.when(F.size("valid") > 0, F.transform("valid", lambda i: F.element_at("sources", i))).otherwise(F.col("sources"))
    return rows.select("id", "pos", strip_citations(F.col("sentence")).alias("hypothesis"), F.array_join(chosen, "\n").alias("premise"), "cited", "valid")


def report(scored: DataFrame, n_sources: DataFrame) -> DataFrame:
    """(id, n, entailed, contradicted, validity, coverage, score) from scored (id, cited, valid, entailment, contradiction) and n_sources (id, n_sources)."""
    by = scored.groupBy("id").agg(
        F.count("*").alias("n"),
        F.avg((F.col("entailment") >= ENTAILED).cast("double")).alias("entailed"),
        F.avg((F.col("contradiction") >= CONTRADICTED).cast("double")).alias("contradicted"),
        F.sum(F.size("cited")).alias("n_cited"),
        F.sum(F.size("valid")).alias("n_valid"),
        F.size(F.array_distinct(F.flatten(F.collect_list("valid")))).alias("n_used"),
    )
    rows = by.join(n_sources, "id")
    validity = F.when(F.col("n_cited") > 0, F.col("n_valid") / F.col("n_cited")).otherwise(F.lit(0.0))
    coverage = F.when(F.col("n_sources") > 0, F.col("n_used") / F.col("n_sources")).otherwise(F.lit(0.0))
    score = WEIGHTS["entailed"] * F.col("entailed") + WEIGHTS["validity"] * validity + WEIGHTS["coverage"] * coverage + WEIGHTS["consistent"] * (1 - F.col("contradicted"))
    return rows.select("id", "n", "entailed", "contradicted", validity.alias("validity"), coverage.alias("coverage"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))
