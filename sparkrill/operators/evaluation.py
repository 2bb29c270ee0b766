"""Offline-evaluation statistics as aggregations: agreement, calibration, significance, intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkrill.operators.ranking import globally_ranked

BINS = 15


def confusion(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n) over the full grid of labels that occur on either side."""
    counts = rows.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("truth", "pred")).alias("label")).distinct()
    # The labels of a classification are few; the grid is their square.
    grid = labels.select(F.col("label").alias("truth")).join(F.broadcast(labels.select(F.col("label").alias("pred"))))
    return grid.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of a confusion matrix; 0 where a ratio has no denominator."""
    sides = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("fn_tp"), F.lit(0).cast("bigint").alias("fp_tp"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("fn_tp"), F.col("n").alias("fp_tp"), F.lit(0).cast("bigint").alias("tp")))).alias("s")).select("s.*")
    by = sides.groupBy("label").agg(F.sum("fn_tp").alias("support"), F.sum("fp_tp").alias("predicted"), F.sum("tp").alias("tp"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    by = by.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return by.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support", "tp")


def summary(matrix: DataFrame) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1, n), one row."""
    by = class_report(matrix)
    return by.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"))


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function; no built-in has it."""
    import math

    return x.map(lambda v: None if v is None else math.erfc(v))


def mcnemar(rows: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """(b, c, statistic, p): b: only the first is right, c: only the second. Exact binomial p below 25 discordant pairs, else chi-squared with continuity correction."""
    counts = rows.agg(F.count_if((F.col(a) == F.col(truth)) & (F.col(b) != F.col(truth))).alias("b"), F.count_if((F.col(a) != F.col(truth)) & (F.col(b) == F.col(truth))).alias("c"))
    return mcnemar_of(counts)


def mcnemar_of(counts: DataFrame) -> DataFrame:
    n, low = F.col("b") + F.col("c"), F.least("b", "c")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    # Sum of C(n, i) for i up to the smaller count; each term comes from the one before.
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), low), start, lambda s, i: F.struct((s["term"] * (n - i) / (i + 1)).alias("term"), (s["total"] + s["term"]).alias("total")), lambda s: s["total"])
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n.cast("double")))
    chi = F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / n
    small = n < 25
    rows = counts.withColumn("statistic", F.when(small, low.cast("double")).otherwise(chi))
    return rows.withColumn("p", F.when(n == 0, F.lit(1.0)).when(small, exact).otherwise(erfc(F.sqrt(F.when(~small, F.col("statistic") / 2)))))


def ece(rows: DataFrame, confidence: str, correct: str, bins: int = BINS) -> DataFrame:
    """(bin, n, mean_confidence, accuracy) of equal-width bins; a confidence of 1 is in the last."""
    index = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def ece_adaptive(rows: DataFrame, confidence: str, correct: str, key: str, bins: int = BINS) -> DataFrame:
    """The same for bins of equal size by rank."""
    total = rows.agg(F.count("*").alias("total"))
    ranked = globally_ranked(rows, [F.col(confidence), F.col(key)]).crossJoin(F.broadcast(total))
    index = F.floor((F.col("rank") * bins - 1) / F.col("total")).cast("int")
    return ranked.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(binned: DataFrame) -> DataFrame:
    """(ece), one row: the mean gap of the bins, weighted by their size."""
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"))


def brier(rows: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """(brier, nll), one row: the mean squared error over all labels, and the mean negative log-likelihood of the truth."""
    squares = sum((F.pow(F.col(p) - (F.col(truth) == label).cast("double"), F.lit(2)) for label, p in probabilities.items()), F.lit(0.0))
    own = F.coalesce(*[F.when(F.col(truth) == label, F.col(p)) for label, p in probabilities.items()], F.lit(0.0))
    return rows.agg(F.avg(squares).alias("brier"), F.avg(-F.ln(F.greatest(own, F.lit(1e-12)))).alias("nll"))


def risk_coverage(rows: DataFrame, confidence: str, correct: str, key: str) -> DataFrame:
    """rows with rank, coverage and risk: the error rate of all rows at least as confident."""
    wrong = rows.withColumn("wrong", 1 - F.col(correct).cast("int"))
    total = rows.agg(F.count("*").alias("total"))
    ranked = globally_ranked(wrong, [F.col(confidence).desc(), F.col(key)], ["wrong"]).crossJoin(F.broadcast(total))
    return ranked.withColumn("coverage", F.col("rank") / F.col("total")).withColumn("risk", F.col("cum_wrong") / F.col("rank"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """tests with p_adjusted, monotone in p and at most 1. Tests are a small table: one per comparison."""
    whole = W.partitionBy()
    ranked = tests.withColumn("_rank", F.row_number().over(whole.orderBy(p, key))).withColumn("_m", F.count("*").over(whole))
    down = whole.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa), one row; kappa is 1 without pairs or where chance agreement is complete."""
    cells = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")).alias("observed"))
    left, right = cells.groupBy(F.col("x").alias("label")).agg(F.sum("n").alias("nx")), cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("ny"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("nx").cast("double") * F.col("ny")), F.lit(0.0)).alias("both"))
    size = F.nullif("n", F.lit(0))
    expected = F.col("both") / size / size
    return total.crossJoin(chance).select("n", "observed", expected.alias("expected"), F.when((F.col("n") == 0) | (expected >= 1), F.lit(1.0)).otherwise((F.col("observed") - expected) / (1 - expected)).alias("kappa"))


def krippendorff(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """(alpha), one row: nominal alpha of ratings with missing values; units with one rating don't count. From counts alone, without pairs."""
    cells = ratings.filter(F.col(value).isNotNull()).groupBy(F.col(unit).alias("u"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    units = cells.groupBy("u").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).filter("m >= 2")
    disagreed = units.agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("o"), F.sum("m").alias("total"))
    totals = cells.join(units.select("u"), "u").groupBy("v").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    both = disagreed.crossJoin(totals)
    total = F.col("total").cast("double")
    observed, expected = F.col("o") / F.nullif("total", F.lit(0)), (total * total - F.col("sq")) / F.nullif(total * (total - 1), F.lit(0.0))
    return both.select(F.when(expected > 0, 1 - observed / expected).otherwise(F.lit(1.0)).alias("alpha"))


def bootstrap_means(rows: DataFrame, value: str, rounds: int, seed: str = "0") -> DataFrame:
    """(round, statistic): means over resamples with replacement of the same size.

    rows: i (0-based, consecutive) and value. Draw j of round r is the row at the md5 of seed, round and draw, modulo the size:
    any engine can repeat it.
    """
    return bootstrap(rows, F.avg(value), rounds, seed)


def resampled(rows: DataFrame, rounds: int, seed: str = "0") -> DataFrame:
    """rows (i, ...) drawn for each round as in bootstrap_means, with the round."""
    total = rows.count()
    draws = rows.sparkSession.range(rounds * total).select(F.floor(F.col("id") / max(total, 1)).alias("round"), F.pmod("id", F.lit(max(total, 1))).alias("j"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("round").cast("string"), F.col("j").cast("string")))
    picked = draws.select("round", F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"), F.lit(max(total, 1))).alias("i"))
    return picked.join(rows, "i")


def bootstrap(rows: DataFrame, statistic: Column, rounds: int, seed: str = "0") -> DataFrame:
    """(round, statistic): any aggregate over the resamples of bootstrap_means."""
    return resampled(rows, rounds, seed).groupBy("round").agg(statistic.alias("statistic"))


def paired_f1_delta(rows: DataFrame, truth: str, a: str, b: str, rounds: int, seed: str = "0") -> DataFrame:
    """(round, statistic): macro F1 of a less that of b, over the same resample of rows (i, truth, a, b) for both; labels are those that occur in it on any side."""
    cells = resampled(rows, rounds, seed).groupBy("round", F.col(truth).alias("t"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).alias("pa"), F.lit(0).alias("pb"), F.when(F.col("t") == F.col("a"), F.col("n")).otherwise(0).alias("ta"), F.when(F.col("t") == F.col("b"), F.col("n")).otherwise(0).alias("tb")),
        F.struct(F.col("a").alias("label"), F.lit(0).alias("support"), F.col("n").alias("pa"), F.lit(0).alias("pb"), F.lit(0).alias("ta"), F.lit(0).alias("tb")),
        F.struct(F.col("b").alias("label"), F.lit(0).alias("support"), F.lit(0).alias("pa"), F.col("n").alias("pb"), F.lit(0).alias("ta"), F.lit(0).alias("tb")),
    )
    by = cells.select("round", F.explode(sides).alias("s")).groupBy("round", "s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "pa", "pb", "ta", "tb")])
    # F1 is twice the hits over support and predictions together; 0 for a label without either.
    f1a, f1b = (F.coalesce(2 * F.col(t) / F.nullif(F.col("support") + F.col(p), F.lit(0)), F.lit(0.0)) for t, p in (("ta", "pa"), ("tb", "pb")))
    return by.groupBy("round").agg((F.avg(f1a) - F.avg(f1b)).alias("statistic"))


def decided(intervals: DataFrame, a: str, b: str) -> DataFrame:
    """intervals (low, high, ...) with decision: who wins, or nobody where the interval of the difference holds 0."""
    return intervals.withColumn("decision", F.when((F.col("low") <= 0) & (F.col("high") >= 0), "no winner").when(F.col("low") > 0, F.concat(F.lit(a), F.lit(" wins"))).otherwise(F.concat(F.lit(b), F.lit(" wins"))))


def confidence_of(pred: str, probabilities: str) -> Column:
    """The probability of the predicted label in a map, else the largest; 1 without any."""
    own = F.element_at(probabilities, F.col(pred))
    return F.coalesce(own, F.array_max(F.map_values(probabilities)), F.lit(1.0))


def calibration_bundle(rows: DataFrame, truth: str, confidence: str, correct: str, key: str, probabilities: dict[str, str]) -> DataFrame:
    """(ece, ece_adaptive, brier, nll, aurc, proper), one row. Brier score and likelihood only where every row's probabilities add up to 0.9 to 1.1."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in probabilities.values()), F.lit(0.0))
    proper = rows.agg(F.coalesce(F.every(total.between(0.9, 1.1)), F.lit(True)).alias("proper")).first()[0]
    flat = calibration_error(ece(rows, confidence, correct))
    even = calibration_error(ece_adaptive(rows, confidence, correct, key, 10)).withColumnRenamed("ece", "ece_adaptive")
    both = brier(rows, truth, probabilities) if proper else rows.sparkSession.createDataFrame([(None, None)], "brier double, nll double")
    curve = risk_coverage(rows, confidence, correct, key).agg(F.avg("risk").alias("aurc"))
    return flat.join(F.broadcast(even)).join(F.broadcast(both)).join(F.broadcast(curve)).withColumn("proper", F.lit(proper))


def interval(statistics: DataFrame, level: float = 0.95) -> DataFrame:
    """(low, high), one row: the percentile interval of the statistics of `rounds` resamples."""
    values = statistics.agg(F.array_sort(F.collect_list("statistic")).alias("v"))
    n = F.size("v")
    low, high = F.floor(F.lit((1 - level) / 2) * n).cast("int"), (F.floor(F.lit((1 + level) / 2) * n) - 1).cast("int")
    return values.select(F.get("v", low).alias("low"), F.get("v", high).alias("high"))


def class_weights(rows: DataFrame, label: str, kind: str = "effective", beta: float = 0.999) -> DataFrame:
    """(label, n, weight) with mean weight 1: inverse, sqrt, or by the effective number of samples."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    raw = {"inverse": 1 / F.col("n"), "sqrt": 1 / F.sqrt("n"), "effective": (1 - F.lit(beta)) / (1 - F.pow(F.lit(beta), F.col("n")))}[kind]
    return counts.withColumn("w", raw).select("label", "n", (F.col("w") / F.avg("w").over(W.partitionBy())).alias("weight"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows, round robin over the strata, in hash order within each: rows with place and h. Only the first n of a stratum can be drawn."""
    hashed = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    ranked = hashed.withColumn("place", F.row_number().over(W.partitionBy(stratum).orderBy("h"))).filter(F.col("place") <= n)
    return ranked.orderBy("place", "h").limit(n)


def stratified_split(rows: DataFrame, label: str, key: str, share: float, seed: str = "0") -> DataFrame:
    """(key, label, part): round(n * share) rows of each label to validation, in hash order; a label's only row trains."""
    hashed = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).withColumn("_b", F.substring("h", 1, 4))
    # Counts by the first four digits tell in which bucket a label's cutoff lies; only that one is ranked. No label's rows meet in a task.
    of_label = W.partitionBy("_l")
    counts = hashed.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_cut")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(of_label.orderBy("_cut"))).withColumn("n", F.sum("c").over(of_label)).withColumn("need", F.when(F.col("n") > 1, F.bround(F.col("n") * F.lit(share))).otherwise(0))
    edge = upto.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need"))).select("_l", "_cut", (F.col("need") - F.col("upto") + F.col("c")).alias("left"))
    joined = hashed.join(F.broadcast(edge), F.col(label).eqNullSafe(F.col("_l")), "left")
    at = joined.filter("_b = _cut").withColumn("place", F.row_number().over(W.partitionBy("_l").orderBy("h", key)))
    held = F.coalesce(F.col("_b") < F.col("_cut"), F.lit(False))
    rest = joined.filter("_cut is null or _b <> _cut").select(key, label, F.when(held, "validation").otherwise("train").alias("part"))
    return rest.unionByName(at.select(key, label, F.when(F.col("place") <= F.col("left"), "validation").otherwise("train").alias("part")))
