"""Summaries, labels and packs on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from sparkrill.operators import summaries as S


def _one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_parse_and_validate(spark):
    raw = "```\n摘要：\n- Cats sleep [1]\n2. Dogs bark\n\nBirds fly [9]\n```"
    assert _one(spark, raw, S.parse_summary(F.col("x"))) == "Cats sleep [1]\nDogs bark\nBirds fly [9]"
    assert _one(spark, "a［1，2］b[2]", S.extract_ids(F.col("x"))) == [1, 2, 2]
    df = spark.createDataFrame([("Cats sleep [1]\nDogs bark\nBirds fly [9]", 2), ("[1]", 1), (None, 1), ("All good [1]", 1)], "t string, n int")
    got = [r.issues for r in S.validated(df, "t", "n").collect()]
    assert got[0].uncited_sentences == ["Dogs bark"] and got[0].out_of_range_ids == [9] and not got[0].ok
    assert got[1].empty and got[2].empty and got[3].ok
    v = S.citation_validity(df, "t", "n").first().validity
    assert v.rate == pytest.approx(1 / 3) and v.cited_sources == [1] and v.coverage == 0.5


def test_numbers_gates_and_packs(spark):
    sentences = spark.createDataFrame([("e", 0, 7, "a"), ("e", 1, 5, "b"), ("e", 2, 7, "c"), ("e", 3, None, "d")], "event string, pos int, post_id int, text string")
    assert [r.source_id for r in S.numbered_sources(sentences).orderBy("pos").collect()] == [1, 2, 1, 3]
    assert S.source_block(sentences).first().sources == "[1] a\n[2] b\n[3] c\n[4] d"
    rows = spark.createDataFrame([(0, "x", 1.0), (1, "", 1.0), (1, "no mark", 1.0), (1, "fine [1]", 0.2), (1, "fine [1]", 0.9), (1, "fine [1]", None)], "n_sentences int, t string, faithfulness_score double").withColumn("n", F.lit(1)).withColumn("post_ids", F.array(F.lit(2), F.lit(10)))
    assert [r.status for r in S.gated_records(S.validated(rows, "t", "n")).collect()] == ["no_key_sentences", "empty_summary", "format_issues", "low_faithfulness", "ok", "ok"]
    posts = spark.createDataFrame([(2, "a", "T", "s", "u"), (1, "?", None, None, None)], "id int, theme string, title string, source string, url string")
    assert {(r.theme, r.n): r.line for r in S.knowledge_pack(posts, ["a", "z"]).collect()} == {("a", 1): "- **T**（s） [1]\n  - u", ("z", 1): "- **(untitled)** [1]"}


def test_labels(spark):
    scores = F.from_json(F.col("x"), "map<string,double>")
    assert tuple(_one(spark, '{"a": 0.6, "b": 0.41}', S.pick_theme(scores, "other"))) == ("a", 0.6, True, "b")
    assert tuple(_one(spark, '{"a": 0.44}', S.pick_theme(scores, "other"))) == ("other", 0.44, False, None)
    labels = {"positive": "positive", "negative": "negative", "負面": "negative"}
    assert _one(spark, "It is Negative, not positive", S.first_match(F.col("x"), labels)) == "negative"
    assert _one(spark, "none", S.first_match(F.col("x"), labels)) is None
    h = 0x811C9DC5
    for c in b"event-1":
        h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
    assert _one(spark, "event-1", S.event_number(F.col("x"))) == -h - 1


def test_temperature(spark):
    rows = spark.createDataFrame([([4.0, 0.0], 0)] * 7 + [([4.0, 0.0], 1)] * 3, "logits array<double>, label int")
    import math

    assert S.fitted_temperature(rows, "logits", "label") == pytest.approx(4 / math.log(7 / 3), rel=1e-2)
