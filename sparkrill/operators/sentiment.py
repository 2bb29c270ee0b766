"""Soft sentiment index, polarisation and flips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrill.operators.quality import SARCASM

SHRINK, BAND = 3.0, 10
MIN_SAMPLES, FLIP, Z = 5, 20, 1.959963984540054


def index(score: str = "score", positive: str = "p_positive", negative: str = "p_negative", shrink: float = SHRINK) -> Column:
    """Confidence-weighted index in -100..100, shrunk for few samples; null without any weight."""
    weight, n = F.sum(F.col(score)), F.count(F.col(score))
    value = F.sum(F.col(score) * (F.col(positive) - F.col(negative))) / weight * (n / (n + F.lit(shrink)))
    return F.when(weight > 0, F.bround(100 * value).cast("int"))


def polarisation(n_positive: Column, n_negative: Column, n: Column) -> Column:
    return F.bround(200 * F.least(n_positive, n_negative) / n).cast("int")


def index_label(value: Column) -> Column:
    return F.when(value > BAND, "positive").when(value < -BAND, "negative").otherwise("neutral")


def mood_word(value: Column) -> Column:
    """The word for an index: bands at 10 and 30 on either side."""
    return F.when(value >= 30, "very positive").when(value >= 10, "positive").when(value > -10, "neutral").when(value > -30, "negative").otherwise("very negative")


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """z of two shares; 0 where either side is empty or the pooled share has no spread."""
    pooled = (x1 + x2) / (n1 + n2)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return F.when((n1 > 0) & (n2 > 0) & (spread > 0), (x1 / n1 - x2 / n2) / spread).otherwise(F.lit(0.0))


def flip_direction(before: Column, after: Column, n_before: Column, n_after: Column, z: Column) -> Column:
    """to_positive or to_negative where enough samples, a significant z and an index that crosses from one threshold to the other meet; else null."""
    sure = (n_before >= MIN_SAMPLES) & (n_after >= MIN_SAMPLES) & (F.abs(z) > Z)
    return F.when(sure & (before <= -FLIP) & (after >= FLIP), "to_positive").when(sure & (before >= FLIP) & (after <= -FLIP), "to_negative")


def confident(positive: Column, neutral: Column, negative: Column, least: float = 0.5, margin: float = 0.1) -> Column:
    """Whether the top probability is large enough and clearly above the next one; otherwise the label is left open."""
    ranked = F.sort_array(F.array(positive, neutral, negative), asc=False)
    return (F.get(ranked, F.lit(0)) >= least) & (F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)) >= margin)


def signed(label: Column, score: Column) -> Column:
    """The score with the label's sign, 0 for neutral."""
    return F.when(label == "positive", score).when(label == "negative", -score).otherwise(F.lit(0.0))


def label_of(positive: Column, neutral: Column, negative: Column) -> Column:
    """struct<label, score> of the top probability; of equal ones the first of positive, neutral, negative."""
    top = F.greatest(positive, neutral, negative)
    return F.struct(F.when(positive == top, "positive").when(neutral == top, "neutral").otherwise("negative").alias("label"), top.alias("score"))


def is_sarcastic(text: Column) -> Column:
    return F.coalesce(text.rlike(SARCASM), F.lit(False))
