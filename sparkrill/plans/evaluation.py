"""The statistics over human labels against two classifiers: the stored sentiment, and one that only weighs its probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrill.operators import evaluation as E
from sparkrill.operators.ranking import globally_ranked
from sparkrill.operators.summaries import fitted_temperature
from sparkrill.plans import base
from sparkrill.storage import new_folder, written
from sparkrill.tables import table

ROUNDS = 200
PROBABILITIES = {"positive": "p_positive", "neutral": "p_neutral", "negative": "p_negative"}


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(post_id, truth, pred_a, pred_b, confidence, correct, p_*) of the posts with a first-round label and a stored sentiment."""
    gold = table(spark, d, "gold_labels").filter("round = 1 and sentiment is not null").select("post_id", F.col("sentiment").alias("truth")).distinct()
    other = F.when(F.col("p_positive") - F.col("p_negative") > 0.05, "positive").when(F.col("p_positive") - F.col("p_negative") < -0.05, "negative").otherwise("neutral")
    return gold.join(base.sentiments(spark, d), "post_id").select("post_id", "truth", F.col("label").alias("pred_a"), other.alias("pred_b"), F.col("score").alias("confidence"), (F.col("label") == F.col("truth")).alias("correct"), *PROBABILITIES.values())


_L = """
l AS (SELECT g.post_id, g.truth, s.label AS pred_a, CASE WHEN p_positive - p_negative > 0.05 THEN 'positive' WHEN p_positive - p_negative < -0.05 THEN 'negative' ELSE 'neutral' END AS pred_b, s.score AS confidence, CAST(s.label = g.truth AS INTEGER) AS correct, p_positive, p_neutral, p_negative
FROM (SELECT DISTINCT post_id, sentiment AS truth FROM gold_labels WHERE round = 1 AND sentiment IS NOT NULL) g JOIN (SELECT DISTINCT * FROM sentiments) s ON s.post_id = g.post_id)
"""
_MATRIX = f"{_L}, n AS (SELECT truth, pred_a AS pred, count(*) AS n FROM l GROUP BY 1, 2), labels AS (SELECT truth AS label FROM n UNION SELECT pred FROM n), m AS (SELECT a.label AS truth, b.label AS pred, coalesce(n.n, 0) AS n FROM labels a CROSS JOIN labels b LEFT JOIN n ON n.truth = a.label AND n.pred = b.label)"
_REPORT = f"""{_MATRIX}, k AS (SELECT label, (SELECT sum(n) FROM m WHERE truth = label) AS support, (SELECT sum(n) FROM m WHERE pred = label) AS predicted, (SELECT sum(n) FROM m WHERE pred = label AND truth = label) AS tp FROM labels),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM k), r AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(labelled(spark, d), "truth", "pred_a")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def class_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.class_report(_matrix(spark, d)), "precision", "recall", "f1").select("label", "precision", "recall", "f1", "support")


def f1_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.summary(_matrix(spark, d)), "accuracy", "macro_f1", "weighted_f1")


def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.mcnemar(labelled(spark, d), "truth", "pred_a", "pred_b"), "statistic", "p")


# The complementary error function by its series, which DuckDB lacks.
MCNEMAR = f"""
WITH {_L}, t AS (SELECT count(*) FILTER (WHERE pred_a = truth AND pred_b <> truth) AS b, count(*) FILTER (WHERE pred_a <> truth AND pred_b = truth) AS c FROM l), s AS (SELECT *, b + c AS n, CASE WHEN b + c < 25 THEN CAST(least(b, c) AS DOUBLE) ELSE pow(abs(b - c) - 1, 2) / (b + c) END AS statistic FROM t),
x AS (SELECT *, sqrt(statistic / 2) AS x FROM s)
SELECT b, c, round(statistic, 9) AS statistic, round(CASE WHEN n = 0 THEN 1.0
  WHEN n < 25 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)))) / pow(2, n))
  WHEN x = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 300), lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln(x) + lgamma(k + 1) - lgamma(2 * k + 2)))) END, 9) AS p FROM x
"""


def mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.mcnemar(labelled(spark, d), "truth", "pred_a", "pred_b").select("b", "c", "statistic"), "statistic")


def ece(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.calibration_error(E.ece(labelled(spark, d), "confidence", "correct")), "ece")


def ece_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.calibration_error(E.ece_adaptive(labelled(spark, d), "confidence", "correct", "post_id")), "ece")


_GAP = "round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece"


def brier_nll(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.brier(labelled(spark, d), "truth", PROBABILITIES), "brier", "nll")


def aurc(spark: SparkSession, d: str) -> DataFrame:
    """The area under the risk-coverage curve, and the accuracy at two coverages."""
    curve = E.risk_coverage(labelled(spark, d), "confidence", "correct", "post_id")
    at = [F.max(F.when(F.col("rank") == F.greatest(F.lit(1), F.bround(F.lit(c) * F.col("total"))), 1 - F.col("risk"))).alias(name) for c, name in ((0.5, "accuracy_50"), (0.8, "accuracy_80"))]
    return _rounded(curve.agg(F.avg("risk").alias("aurc"), *at), "aurc", "accuracy_50", "accuracy_80")


AURC = f"""
WITH {_L}, r AS (SELECT *, row_number() OVER w AS rank, sum(1 - correct) OVER w / row_number() OVER w AS risk, count(*) OVER () AS total FROM l WINDOW w AS (ORDER BY confidence DESC, post_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(avg(risk), 9) AS aurc, round(max(1 - risk) FILTER (WHERE rank = greatest(1, round_even(0.5 * total, 0))), 9) AS accuracy_50, round(max(1 - risk) FILTER (WHERE rank = greatest(1, round_even(0.8 * total, 0))), 9) AS accuracy_80 FROM r
"""


def bh_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted p of the exact test, by source, whether the two classifiers differ there."""
    rows = labelled(spark, d).join(base.posts(spark, d).select(F.col("id").alias("post_id"), F.col("source").alias("name")), "post_id")
    counts = rows.groupBy("name").agg(F.count_if((F.col("pred_a") == F.col("truth")) & (F.col("pred_b") != F.col("truth"))).alias("b"), F.count_if((F.col("pred_a") != F.col("truth")) & (F.col("pred_b") == F.col("truth"))).alias("c"))
    tests = E.mcnemar_of(counts.filter(F.col("b") + F.col("c") < 25))
    return _rounded(E.benjamini_hochberg(tests).select("name", "b", "c", "p", "p_adjusted"), "p", "p_adjusted")


BH = f"""
WITH {_L}, t AS (SELECT p.source AS name, count(*) FILTER (WHERE pred_a = truth AND pred_b <> truth) AS b, count(*) FILTER (WHERE pred_a <> truth AND pred_b = truth) AS c FROM l JOIN posts p ON p.id = l.post_id GROUP BY 1),
f AS (SELECT name, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: factorial(CAST(b + c AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(b + c - i AS INTEGER))))) / pow(2, b + c)) END AS p FROM t WHERE b + c < 25),
r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM f)
SELECT name, b, c, round(p, 9) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC)), 9) AS p_adjusted FROM r
"""


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "gold_labels").select("post_id", "round", "sentiment").distinct()
    first, second = gold.filter("round = 1").select("post_id", F.col("sentiment").alias("x")), gold.filter("round = 2").select("post_id", F.col("sentiment").alias("y"))
    return first.join(second, "post_id").filter("x is not null and y is not null")


def kappa(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.kappa(_rounds(spark, d), "x", "y"), "observed", "expected", "kappa")


_ROUNDS = "g AS (SELECT DISTINCT post_id, round, sentiment FROM gold_labels WHERE sentiment IS NOT NULL), pairs AS (SELECT a.sentiment AS x, b.sentiment AS y FROM g a JOIN g b ON b.post_id = a.post_id AND a.round = 1 AND b.round = 2)"
KAPPA = f"""
WITH {_ROUNDS}, t AS (SELECT count(*) AS n, avg(CAST(x = y AS INTEGER)) AS observed FROM pairs), e AS (SELECT sum(CAST(a.c AS DOUBLE) * b.c) AS s FROM (SELECT x, count(*) AS c FROM pairs GROUP BY x) a JOIN (SELECT y, count(*) AS c FROM pairs GROUP BY y) b ON a.x = b.y)
SELECT n, round(observed, 9) AS observed, CASE WHEN n > 0 THEN round(coalesce(s, 0) / n / n, 9) END AS expected, CASE WHEN n = 0 OR coalesce(s, 0) / n / n >= 1 THEN 1.0 ELSE round((observed - coalesce(s, 0) / n / n) / (1 - coalesce(s, 0) / n / n), 9) END AS kappa FROM t CROSS JOIN e
"""


def alpha(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "gold_labels").select("post_id", "round", "sentiment").distinct()
    return _rounded(E.krippendorff(gold, "post_id", "sentiment"), "alpha")


ALPHA = """
WITH g AS (SELECT DISTINCT post_id, round, sentiment FROM gold_labels WHERE sentiment IS NOT NULL), u AS (SELECT post_id, count(*) AS m FROM g GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT g.*, u.m, row_number() OVER () AS k FROM g JOIN u ON u.post_id = g.post_id),
o AS (SELECT sum(CASE WHEN a.sentiment <> b.sentiment THEN 1.0 / (a.m - 1) ELSE 0 END) AS o FROM r a JOIN r b ON a.post_id = b.post_id AND a.k <> b.k), t AS (SELECT sum(c) AS total, sum(CAST(c AS DOUBLE) * c) AS sq FROM (SELECT sentiment, count(*) AS c FROM r GROUP BY 1))
SELECT coalesce(round(1 - (o / total) / ((CAST(total AS DOUBLE) * total - sq) / (CAST(total AS DOUBLE) * (total - 1))), 9), 1.0) AS alpha FROM o CROSS JOIN t
"""


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """The 95 % interval of the accuracy, from resamples that any engine can repeat."""
    rows = globally_ranked(labelled(spark, d).select("post_id", F.col("correct").cast("double").alias("value")), [F.col("post_id")]).select((F.col("rank") - 1).alias("i"), "value")
    return _rounded(E.interval(E.bootstrap_means(rows, "value", ROUNDS)), "low", "high")


BOOTSTRAP = f"""
WITH {_L}, v AS (SELECT row_number() OVER (ORDER BY post_id) - 1 AS i, CAST(correct AS DOUBLE) AS value, count(*) OVER () AS total FROM l), dr AS (SELECT r.range AS round, j.range AS j, (SELECT max(total) FROM v) AS total FROM range({ROUNDS}) r CROSS JOIN range((SELECT max(total) FROM v)) j),
p AS (SELECT round, CAST(('0x' || substring(md5('0:' || round || ':' || j), 1, 12)) AS BIGINT) % total AS i FROM dr), s AS (SELECT round, avg(value) AS m FROM p JOIN v ON v.i = p.i GROUP BY round), a AS (SELECT list_sort(list(m)) AS v FROM s)
SELECT round(v[CAST(floor(0.025 * len(v)) AS BIGINT) + 1], 9) AS low, round(v[CAST(floor(0.975 * len(v)) AS BIGINT)], 9) AS high FROM a
"""


def win_rate(spark: SparkSession, d: str) -> DataFrame:
    """How often the first classifier gives the truth more probability than an even guess by a margin, how often less, and the mean difference."""
    own = F.coalesce(*[F.when(F.col("truth") == label, F.col(p)) for label, p in PROBABILITIES.items()])
    diff = labelled(spark, d).select((own - F.lit(1 / 3)).alias("diff"))
    return _rounded(diff.agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0.05).alias("wins"), F.count_if(F.col("diff") < -0.05).alias("losses"), F.avg("diff").alias("mean"), F.percentile("diff", F.lit(0.5)).alias("median")), "mean", "median")


WIN_RATE = f"WITH {_L}, x AS (SELECT CASE truth WHEN 'positive' THEN p_positive WHEN 'neutral' THEN p_neutral WHEN 'negative' THEN p_negative END - 1.0 / CAST(3 AS DOUBLE) AS diff FROM l) SELECT count(*) AS n, count(*) FILTER (WHERE diff > 0.05) AS wins, count(*) FILTER (WHERE diff < -0.05) AS losses, round(avg(diff), 9) AS mean, round(median(diff), 9) AS median FROM x"


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.class_weights(labelled(spark, d), "truth"), "weight")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Thirty first-round labels, round robin over the sources."""
    gold = table(spark, d, "gold_labels").filter("round = 1").select("post_id", "source").distinct()
    return E.stratified_sample(gold, "source", "post_id", 30).select("post_id", "source", "place")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return E.stratified_split(labelled(spark, d), "truth", "post_id", 0.2)


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    return globally_ranked(labelled(spark, d), [F.col("post_id")]).withColumn("i", F.col("rank") - 1).drop("rank")


def f1_delta_ci(spark: SparkSession, d: str) -> DataFrame:
    """The interval of the difference of macro F1 of the two classifiers over the same resamples, and who wins."""
    found = E.paired_f1_delta(_indexed(spark, d).select("i", "truth", "pred_a", "pred_b"), "truth", "pred_a", "pred_b", ROUNDS)
    return _rounded(E.decided(E.interval(found), "a", "b"), "low", "high")


_DRAWS = f"v AS (SELECT *, row_number() OVER (ORDER BY post_id) - 1 AS i, count(*) OVER () AS total FROM l), dr AS (SELECT r.range AS round, j.range AS j, (SELECT max(total) FROM v) AS total FROM range({ROUNDS}) r CROSS JOIN range((SELECT max(total) FROM v)) j), p AS (SELECT round, CAST(('0x' || substring(md5('0:' || round || ':' || j), 1, 12)) AS BIGINT) % total AS i FROM dr), rs AS (SELECT p.round, v.* EXCLUDE (i, total) FROM p JOIN v ON v.i = p.i)"
_BOUNDS = "round(v[CAST(floor(0.025 * len(v)) AS BIGINT) + 1], 9) AS low, round(v[CAST(floor(0.975 * len(v)) AS BIGINT)], 9) AS high"
_DECISION = "CASE WHEN low <= 0 AND high >= 0 THEN 'no winner' WHEN low > 0 THEN 'a wins' ELSE 'b wins' END AS decision"
F1_DELTA = f"""
WITH {_L}, {_DRAWS}, sides AS (SELECT round, truth AS label, 1 AS s, 0 AS pa, 0 AS pb, CAST(truth = pred_a AS INTEGER) AS ta, CAST(truth = pred_b AS INTEGER) AS tb FROM rs UNION ALL SELECT round, pred_a, 0, 1, 0, 0, 0 FROM rs UNION ALL SELECT round, pred_b, 0, 0, 1, 0, 0 FROM rs),
f AS (SELECT round, label, CASE WHEN sum(s) + sum(pa) > 0 THEN 2 * sum(ta) / (sum(s) + sum(pa)) ELSE 0 END AS fa, CASE WHEN sum(s) + sum(pb) > 0 THEN 2 * sum(tb) / (sum(s) + sum(pb)) ELSE 0 END AS fb FROM sides GROUP BY 1, 2),
a AS (SELECT list_sort(list(x)) AS v FROM (SELECT round, avg(fa) - avg(fb) AS x FROM f GROUP BY round)), b AS (SELECT {_BOUNDS} FROM a) SELECT low, high, {_DECISION} FROM b
"""


def mean_delta_ci(spark: SparkSession, d: str) -> DataFrame:
    """The interval of the mean difference of the two classifiers' hits, paired by post, with wins, losses and the decision."""
    hit = [(F.col(p) == F.col("truth")).cast("double") for p in ("pred_a", "pred_b")]
    rows = _indexed(spark, d).select("i", (hit[0] - hit[1]).alias("diff"))
    counts = rows.agg(F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") < 0).alias("losses"), F.count_if(F.col("diff") == 0).alias("ties"))
    found = E.decided(E.interval(E.bootstrap(rows, F.avg("diff"), ROUNDS)), "a", "b")
    return _rounded(found.join(F.broadcast(counts)), "low", "high")


MEAN_DELTA = f"""
WITH {_L}, {_DRAWS}, a AS (SELECT list_sort(list(x)) AS v FROM (SELECT round, avg(CAST(pred_a = truth AS INTEGER) - CAST(pred_b = truth AS INTEGER)) AS x FROM rs GROUP BY round)), b AS (SELECT {_BOUNDS} FROM a),
c AS (SELECT count(*) FILTER (WHERE pred_a = truth AND pred_b <> truth) AS wins, count(*) FILTER (WHERE pred_a <> truth AND pred_b = truth) AS losses, count(*) FILTER (WHERE (pred_a = truth) = (pred_b = truth)) AS ties FROM l) SELECT low, high, {_DECISION}, wins, losses, ties FROM b CROSS JOIN c
"""


def calibration_bundle(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.calibration_bundle(labelled(spark, d), "truth", "confidence", "correct", "post_id", PROBABILITIES), "ece", "ece_adaptive", "brier", "nll", "aurc")


CALIBRATION = f"""
WITH {_L}, flat AS (SELECT sum(n * abs(acc - conf)) / sum(n) AS ece FROM (SELECT least(floor(confidence * 15), 14) AS bin, count(*) AS n, avg(confidence) AS conf, avg(correct) AS acc FROM l GROUP BY 1)),
even AS (SELECT sum(n * abs(acc - conf)) / sum(n) AS ece FROM (SELECT floor((rank * 10 - 1) / total) AS bin, count(*) AS n, avg(confidence) AS conf, avg(correct) AS acc FROM (SELECT *, row_number() OVER (ORDER BY confidence, post_id) AS rank, count(*) OVER () AS total FROM l) GROUP BY 1)),
pr AS (SELECT coalesce(bool_and(coalesce(p_positive, 0) + coalesce(p_neutral, 0) + coalesce(p_negative, 0) BETWEEN 0.9 AND 1.1), true) AS proper FROM l),
own AS (SELECT *, CASE truth WHEN 'positive' THEN p_positive WHEN 'neutral' THEN p_neutral WHEN 'negative' THEN p_negative ELSE 0 END AS own FROM l),
br AS (SELECT avg(pow(p_positive - CAST(truth = 'positive' AS INTEGER), 2) + pow(p_neutral - CAST(truth = 'neutral' AS INTEGER), 2) + pow(p_negative - CAST(truth = 'negative' AS INTEGER), 2)) AS brier, avg(-ln(greatest(own, 1e-12))) AS nll FROM own),
rc AS (SELECT avg(risk) AS aurc FROM (SELECT sum(1 - correct) OVER w / row_number() OVER w AS risk FROM l WINDOW w AS (ORDER BY confidence DESC, post_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
SELECT round(flat.ece, 9) AS ece, round(even.ece, 9) AS ece_adaptive, CASE WHEN proper THEN round(brier, 9) END AS brier, CASE WHEN proper THEN round(nll, 9) END AS nll, round(aurc, 9) AS aurc, proper FROM flat CROSS JOIN even CROSS JOIN pr CROSS JOIN br CROSS JOIN rc
"""


def temperature(spark: SparkSession, d: str) -> DataFrame:
    """The temperature that calibrates the stored probabilities best on the labels, one row."""
    names = list(PROBABILITIES)
    logits = F.array(*[F.ln(F.greatest(F.col(p), F.lit(1e-6))) for p in PROBABILITIES.values()])
    label = F.coalesce(*[F.when(F.col("truth") == n, F.lit(k)) for k, n in enumerate(names)])
    rows = written(labelled(spark, d).filter(F.col("truth").isin(*names) & F.col("p_positive").isNotNull()).select(logits.alias("logits"), label.alias("label")), "logits")
    return spark.createDataFrame([(round(fitted_temperature(rows, "logits", "label"), 1),)], "temperature double")


TEMPERATURE = f"""
WITH {_L}, z AS (SELECT [ln(greatest(p_positive, 1e-6)), ln(greatest(p_neutral, 1e-6)), ln(greatest(p_negative, 1e-6))] AS z, CASE truth WHEN 'positive' THEN 1 WHEN 'neutral' THEN 2 WHEN 'negative' THEN 3 END AS y FROM l WHERE truth IN ('positive', 'neutral', 'negative') AND p_positive IS NOT NULL),
g AS (SELECT exp(ln(0.05) + range * (ln(20) - ln(0.05)) / 4000) AS t FROM range(4001)), s AS (SELECT t, avg(ln(exp((z[1] - list_max(z)) / t) + exp((z[2] - list_max(z)) / t) + exp((z[3] - list_max(z)) / t)) + (list_max(z) - z[y]) / t) AS loss FROM z CROSS JOIN g GROUP BY t)
SELECT round(arg_min(t, loss), 1) AS temperature FROM s
"""


def candidates(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Predictions (post_id, truth, pred) of each candidate: the two classifiers, and one that always says neutral."""
    rows = labelled(spark, d)
    return {name: rows.select("post_id", "truth", pred.alias("pred")) for name, pred in (("stored", F.col("pred_a")), ("weighed", F.col("pred_b")), ("neutral", F.lit("neutral")))}


def bakeoff(found: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """(place, name, macro_f1, accuracy, weighted_f1, delta_low, delta_high, p, p_adjusted, significant): the candidates by macro F1, and the first against
    each other one: the paired interval of the difference, McNemar's p, adjusted for all comparisons. Candidates are few; their rows are not."""
    spark = next(iter(found.values())).sparkSession
    reports = {name: E.summary(E.confusion(rows, "truth", "pred")).first() for name, rows in found.items()}
    ranking = sorted(reports, key=lambda n: (-(reports[n].macro_f1 or 0.0), n))
    winner, tests = ranking[0], []
    for name in ranking[1:]:
        both = found[winner].select("post_id", "truth", F.col("pred").alias("a")).join(found[name].select("post_id", F.col("pred").alias("b")), "post_id")
        rows = written(globally_ranked(both, [F.col("post_id")]).withColumn("i", F.col("rank") - 1).drop("rank"), "bakeoff")
        low, high = E.interval(E.paired_f1_delta(rows, "truth", "a", "b", rounds)).first()
        tests.append((name, low, high, E.mcnemar(rows, "truth", "a", "b").first().p))
    compared = E.benjamini_hochberg(spark.createDataFrame(tests, "name string, delta_low double, delta_high double, p double"))
    table_ = spark.createDataFrame([(k + 1, n, reports[n].macro_f1, reports[n].accuracy, reports[n].weighted_f1) for k, n in enumerate(ranking)], "place int, name string, macro_f1 double, accuracy double, weighted_f1 double")
    sure = ((F.col("delta_low") > 0) | (F.col("delta_high") < 0)) & (F.col("p_adjusted") <= 0.05)
    return table_.join(compared, "name", "left").withColumn("significant", sure).orderBy("place")


def bakeoff_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(bakeoff(candidates(spark, d)).select("place", "name", "macro_f1", "accuracy", "weighted_f1", "delta_low", "delta_high"), "macro_f1", "accuracy", "weighted_f1", "delta_low", "delta_high")


def _bakeoff_sql() -> str:
    preds = {"stored": "pred_a", "weighed": "pred_b", "neutral": "'neutral'"}
    every = " UNION ALL ".join(f"SELECT '{n}' AS name, post_id, truth, {p} AS pred FROM l" for n, p in preds.items())
    return f"""
WITH {_L}, c AS ({every}), sides AS (SELECT name, truth AS label, 1 AS s, 0 AS p, CAST(truth = pred AS INTEGER) AS t FROM c UNION ALL SELECT name, pred, 0, 1, 0 FROM c),
f AS (SELECT name, label, sum(s) AS s, sum(t) AS t, CASE WHEN sum(s) + sum(p) > 0 THEN 2 * sum(t) / (sum(s) + sum(p)) ELSE 0 END AS f1 FROM sides GROUP BY 1, 2),
m AS (SELECT name, avg(f1) AS macro_f1, sum(t) / sum(s) AS accuracy, sum(f1 * s) / sum(s) AS weighted_f1, row_number() OVER (ORDER BY avg(f1) DESC, name) AS place FROM f GROUP BY name),
v AS (SELECT *, row_number() OVER (ORDER BY post_id) - 1 AS i, count(*) OVER () AS total FROM l), dr AS (SELECT r.range AS round, j.range AS j, (SELECT max(total) FROM v) AS total FROM range({ROUNDS}) r CROSS JOIN range((SELECT max(total) FROM v)) j),
p AS (SELECT round, CAST(('0x' || substring(md5('0:' || round || ':' || j), 1, 12)) AS BIGINT) % total AS i FROM dr),
w AS (SELECT c.name, v.i, c.truth, c.pred AS b, x.pred AS a FROM c JOIN v ON v.post_id = c.post_id JOIN c x ON x.post_id = c.post_id AND x.name = (SELECT name FROM m WHERE place = 1) WHERE c.name <> (SELECT name FROM m WHERE place = 1)),
rs AS (SELECT p.round, w.* FROM p JOIN w ON w.i = p.i),
s2 AS (SELECT name, round, truth AS label, 1 AS s, 0 AS pa, 0 AS pb, CAST(truth = a AS INTEGER) AS ta, CAST(truth = b AS INTEGER) AS tb FROM rs UNION ALL SELECT name, round, a, 0, 1, 0, 0, 0 FROM rs UNION ALL SELECT name, round, b, 0, 0, 1, 0, 0 FROM rs),
g AS (SELECT name, round, label, CASE WHEN sum(s) + sum(pa) > 0 THEN 2 * sum(ta) / (sum(s) + sum(pa)) ELSE 0 END AS fa, CASE WHEN sum(s) + sum(pb) > 0 THEN 2 * sum(tb) / (sum(s) + sum(pb)) ELSE 0 END AS fb FROM s2 GROUP BY 1, 2, 3),
q AS (SELECT name, list_sort(list(x)) AS v FROM (SELECT name, round, avg(fa) - avg(fb) AS x FROM g GROUP BY 1, 2) GROUP BY name), b AS (SELECT name, {_BOUNDS} FROM q)
SELECT CAST(place AS INTEGER) AS place, m.name, round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy, round(weighted_f1, 9) AS weighted_f1, low AS delta_low, high AS delta_high FROM m LEFT JOIN b ON b.name = m.name
"""


def append_runs(ranked: DataFrame, path: str, task: str, evaluation_set: str) -> None:
    """Appends a bake-off to the runs kept at path: a row for each candidate; the first one's names the second and the significance against it."""
    second = ranked.filter("place = 2").select(F.lit(1).alias("place"), F.col("name").alias("baseline"), F.col("p").alias("baseline_p"), F.col("delta_low").alias("baseline_low"), F.col("delta_high").alias("baseline_high"))
    rows = ranked.select("place", "name", "macro_f1", "accuracy", "weighted_f1").join(F.broadcast(second), "place", "left")
    rows.select(F.lit(task).alias("task"), F.lit(evaluation_set).alias("evaluation_set"), "*").write.mode("append").json(path)


def evaluation_runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs kept after the bake-off was appended twice: rows, and the second candidate of each first one's row."""
    ranked, path = written(bakeoff(candidates(spark, d)), "bakeoff"), new_folder(spark, "runs")
    for name in ("gold_v1", "gold_v2"):
        append_runs(ranked, path, "sentiment", name)
    kept = spark.read.schema("task string, evaluation_set string, place int, name string, macro_f1 double, accuracy double, baseline string, baseline_p double").json(path)
    return _rounded(kept.select("task", "evaluation_set", "place", "name", "macro_f1", "accuracy", "baseline"), "macro_f1", "accuracy")


def _runs_sql() -> str:
    return f"WITH ranked AS ({_bakeoff_sql()}) SELECT 'sentiment' AS task, e.evaluation_set, r.place, r.name, r.macro_f1, r.accuracy, CASE WHEN r.place = 1 THEN (SELECT name FROM ranked WHERE place = 2) END AS baseline FROM ranked r CROSS JOIN (VALUES ('gold_v1'), ('gold_v2')) e(evaluation_set)"


QUERIES = {
    "confusion": (_matrix, f"WITH {_MATRIX} SELECT truth, pred, n FROM m"),
    "class_report": (class_report, f"WITH {_REPORT} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM r"),
    "f1_summary": (f1_summary, f"WITH {_REPORT} SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM r"),
    "mcnemar": (mcnemar, MCNEMAR),
    "mcnemar_counts": (mcnemar_counts, f"WITH {_L}, t AS (SELECT count(*) FILTER (WHERE pred_a = truth AND pred_b <> truth) AS b, count(*) FILTER (WHERE pred_a <> truth AND pred_b = truth) AS c FROM l) SELECT b, c, round(CASE WHEN b + c < 25 THEN least(b, c) ELSE pow(abs(b - c) - 1, 2) / (b + c) END, 9) AS statistic FROM t"),
    "ece": (ece, f"WITH {_L}, b AS (SELECT least(floor(confidence * 15), 14) AS bin, count(*) AS n, avg(confidence) AS conf, avg(correct) AS acc FROM l GROUP BY 1) SELECT {_GAP} FROM b"),
    "ece_adaptive": (ece_adaptive, f"WITH {_L}, r AS (SELECT *, row_number() OVER (ORDER BY confidence, post_id) AS rank, count(*) OVER () AS total FROM l), b AS (SELECT floor((rank * 15 - 1) / total) AS bin, count(*) AS n, avg(confidence) AS conf, avg(correct) AS acc FROM r GROUP BY 1) SELECT {_GAP} FROM b"),
    "brier_nll": (brier_nll, f"WITH {_L} SELECT round(avg(pow(p_positive - CAST(truth = 'positive' AS INTEGER), 2) + pow(p_neutral - CAST(truth = 'neutral' AS INTEGER), 2) + pow(p_negative - CAST(truth = 'negative' AS INTEGER), 2)), 9) AS brier, round(avg(-ln(greatest(CASE truth WHEN 'positive' THEN p_positive WHEN 'neutral' THEN p_neutral WHEN 'negative' THEN p_negative ELSE 0 END, 1e-12))), 9) AS nll FROM l"),
    "aurc_accuracy_at_coverage": (aurc, AURC),
    "bh_adjusted": (bh_adjusted, BH),
    "kappa": (kappa, KAPPA),
    "alpha": (alpha, ALPHA),
    "bootstrap_ci": (bootstrap_ci, BOOTSTRAP),
    "f1_delta_ci": (f1_delta_ci, F1_DELTA),
    "mean_delta_ci": (mean_delta_ci, MEAN_DELTA),
    "calibration_bundle": (calibration_bundle, CALIBRATION),
    "temperature": (temperature, TEMPERATURE),
    "bakeoff_ranking": (bakeoff_ranking, _bakeoff_sql()),
    "evaluation_runs": (evaluation_runs, _runs_sql()),
    "win_rate": (win_rate, WIN_RATE),
    "class_weights": (class_weights, f"WITH {_L}, c AS (SELECT truth AS label, count(*) AS n, (1 - 0.999) / (1 - pow(0.999, count(*))) AS w FROM l GROUP BY 1) SELECT label, n, round(w / avg(w) OVER (), 9) AS weight FROM c"),
    "stratified_sample": (stratified_sample, "WITH g AS (SELECT DISTINCT post_id, source FROM gold_labels WHERE round = 1), r AS (SELECT *, md5('0:' || post_id) AS h, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || post_id)) AS place FROM g) SELECT post_id, source, place FROM r ORDER BY place, h LIMIT 30"),
    "stratified_split": (stratified_split, f"WITH {_L}, r AS (SELECT post_id, truth, row_number() OVER (PARTITION BY truth ORDER BY md5('0:' || post_id)) AS place, count(*) OVER (PARTITION BY truth) AS n FROM l) SELECT post_id, truth, CASE WHEN n > 1 AND place <= round_even(n * 0.2, 0) THEN 'validation' ELSE 'train' END AS part FROM r"),
}
