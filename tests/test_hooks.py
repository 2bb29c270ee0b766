"""Injected models, the event pipeline, crawls, bucketed tables, chained jobs and text results, with nulls, empty tables and failures."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from sparkrill.functions import text as T
from sparkrill.operators import evaluation as E
from sparkrill.operators import hooks, pipeline, render
from sparkrill.operators import upsert as U
from sparkrill.plans import base, ingest
from sparkrill.sources import crawl
from sparkrill.streaming import jobs

POSTS = "id bigint, title string, content string, url string, source string, theme string"


def test_models_keep_rows_and_order(spark):
    rows = spark.createDataFrame([(k, None if k == 3 else f"good {k}", k) for k in range(700)], "id int, text string, label int").coalesce(1)
    found = hooks.applied(rows, ["text"], "n", "int", lambda: lambda texts: [len(t) for t in texts]).collect()
    assert [r.id for r in found] == list(range(700)) and found[3].n == 0 and found[10].n == 7
    with pytest.raises(Exception, match="one result for each row"):
        hooks.applied(rows, ["text"], "n", "int", lambda: lambda texts: [1]).collect()
    assert hooks.with_sentiment(rows.filter("false").drop("label"), "text").count() == 0


def test_an_injected_sentiment_model(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    flat = hooks.with_sentiment(rows, "text", lambda: lambda texts: [[2.0, 1.0, 0.0] for _ in texts])
    soft = hooks.with_sentiment(rows, "text", lambda: lambda texts: [[2.0, 1.0, 0.0] for _ in texts], temperature=10.0).first()
    assert {(r.label, r.confident) for r in flat.collect()} == {("positive", True)} and not soft.confident
    assert flat.first().signed == pytest.approx(flat.first().score)


def test_pipeline_with_fake_models(spark):
    """Two alike posts are an event, the third is none; the generator's second sentence cites what isn't there."""
    posts = spark.createDataFrame(
        [(1, "Launch", "The model is out. It is fast.", "u1", "s", "t"), (2, None, "The model is out. It is fast. Really.", "u2", "s", "t"), (3, "Other", "Trains run late.", "u3", "s", None), (4, None, None, None, None, None)], POSTS
    )
    embed = lambda: lambda texts: [[1.0, 0.0] if "model" in t or "fast" in t or "Really" in t else [0.0, 1.0] if t else [0.0, 0.0] for t in texts]
    events, _ = pipeline.clustered(posts, "content", embed)
    assert {(r.event, r.id) for r in events.collect()} == {(1, 1), (1, 2)}
    sentences = pipeline.key_sentences(events, posts, "content", embed, k=2)
    assert {r.text for r in sentences.collect()} <= {"The model is out.", "It is fast.", "Really."} and sentences.count() == 2
    generate = lambda: lambda prompts: ["The model is out [1]。It flies [9]。" for _ in prompts]
    nli = lambda: lambda ps, hs: [[1.0, 0.0] if "out" in h else [0.0, 1.0] for h in hs]
    done = pipeline.summarised(sentences, generate, nli)
    record = pipeline.records(done, sentences, events, posts).first()
    assert record.event_id == "event-1" and record.title == "Launch" and record.member_count == 2
    assert [c.n for c in record.citations] == [1] and record.citations[0].url == "u1" and record.issues.out_of_range_ids == [9]
    assert [r.status for r in pipeline.distilled(done, sentences).collect()] == ["format_issues"]
    assert [r.status for r in pipeline.distilled(done, sentences, require_ok=False).collect()] == ["ok"] or record.faithfulness_score < 0.5
    keys = pipeline.undone(events, spark.createDataFrame([], "event_key string")).collect()
    assert pipeline.undone(events, spark.createDataFrame([(keys[0].event_key,)], "event_key string")).count() == 0
    nothing, _ = pipeline.clustered(posts.filter("false"), "content", embed)
    assert nothing.count() == 0


def test_walks_stop_and_try_again(spark, tmp_path):
    calls, waits = [], []

    def fetch(term, page):
        calls.append((term, page))
        if term == "flaky" and len(calls) < 3:
            raise crawl.Retryable("busy")
        if term == "broken":
            raise ValueError("gone")
        pages = {0: [{"id": 1, "t": 50}, {"id": 2, "t": 99}, {"id": None, "t": 60}], 1: [{"id": 3, "t": 5}, {"id": 4, "t": 4}, {"id": 1, "t": 55}], 2: [{"id": 5, "t": 1}, {"id": 6, "t": 2}, {"id": 7, "t": 3}]}
        return pages.get(page, [])

    found = list(crawl.walk(fetch, "x", "id", lambda r: r["t"], since=4, until=99, page_size=3))
    assert [r["id"] for r in found] == [1, 3, 4] and calls[-1] == ("x", 2)
    calls.clear()
    assert crawl.retried(lambda: fetch("flaky", 0), sleep=waits.append)[0]["id"] == 1 and waits == [1.0, 2.0]
    with pytest.raises(crawl.Retryable):
        crawl.retried(lambda: (_ for _ in ()).throw(crawl.Retryable("always")), sleep=waits.append)
    told = []
    rows = list(crawl.crawled(fetch, ["broken", "x", "y"], "id", lambda r: r["t"], lambda term, error: told.append(term), page_size=3))
    assert told == ["broken"] and [r["id"] for r in rows] == [1, 2, 3, 4, 5, 6, 7]
    assert crawl.land(spark, rows, str(tmp_path / "landed"), chunk=3) == 7
    assert spark.read.schema("id int, t int").json(str(tmp_path / "landed")).count() == 7
    assert crawl.land(spark, [], str(tmp_path / "none")) == 0


def test_strict_records(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, title string")
    assert crawl.strict(rows.filter("id = 1"), ["title"]).count() == 1
    with pytest.raises(Exception, match="record without title"):
        crawl.strict(rows, ["title"]).collect()


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    schema = "id bigint, v int"
    store = U.Snapshots(spark, str(tmp_path / "t"), schema, buckets=8)
    assert store.read().count() == 0
    rows = spark.range(100).select("id", F.lit(0).alias("v"))
    store.upsert(rows, ["id"], ["v"], ["id"], F.col("v"))
    before = store._manifest()["folders"]
    store.upsert(spark.createDataFrame([(5, 7), (5, 6), (None, 1)], schema), ["id"], ["v"], ["id"], F.col("v"))
    after = store._manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.version() == 2
    assert {(r.id, r.v) for r in store.read().filter("v > 0").collect()} == {(5, 7)} and store.read().count() == 100
    with pytest.raises(ValueError):
        store.upsert(rows, ["v"], ["v"], ["id"], F.col("v"))
    store.write(rows.filter("id < 3"), ["id"])
    assert store.read().count() == 3


def test_upsert_stream_and_many_batches(spark, tmp_path):
    """More micro-batches than the progress of a query keeps, none of which may be lost."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(8):
        (folder / f"{k}.json").write_text(json.dumps({"entity": "a", "day": f"2026-01-{k + 1:02d}", "n": 20 if k == 7 else 1}))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("entity string, day date, n bigint").option("maxFilesPerTrigger", 1).json(str(folder))
    old = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        assert jobs.run_to_end(stream.filter("n > 0"), "many", "append").count() == 8
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)
    store = U.Snapshots(spark, str(tmp_path / "days"), "entity string, day date, n bigint")
    jobs.upsert_stream(stream, store, ["entity"], ["day", "n"], ["entity"], "day", str(tmp_path / "state"))
    assert [(r.n, store.version()) for r in store.read().collect()] == [(20, 8)]


def test_jobs_that_wait_for_data(spark, tmp_path):
    folder, schema = str(tmp_path), "id bigint, ok boolean"
    steps = [("checked", lambda rows: rows.filter("ok")), ("counted", lambda rows: rows.agg(F.count("*").alias("n")))]
    spark.createDataFrame([(1, True), (2, False)], schema).write.parquet(f"{folder}/landed/a")
    assert jobs.chained(spark, folder, schema, steps) == ["checked", "counted"]
    assert jobs.chained(spark, folder, schema, steps) == []
    spark.createDataFrame([(3, True)], schema).write.parquet(f"{folder}/landed/b")
    assert jobs.chained(spark, folder, schema, steps) == ["checked", "counted"]
    assert sum(r.n for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/counted").collect()) == 2


def test_one_query_of_a_name(spark, tmp_path):
    stream = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = stream.writeStream.queryName("once").foreachBatch(lambda rows, k: None).option("checkpointLocation", str(tmp_path / "a")).start()
    try:
        assert jobs.start_once(stream, "once", lambda rows, k: None, str(tmp_path / "b")).id == query.id
        assert not jobs.finished_within(query, 1) and not query.isActive
    finally:
        query.stop()


def test_quality_job_leaves_checked_posts(spark):
    schema = "id bigint, source string, title string, content string, author string, models array<string>, quality_score int, quality_flags array<string>, dq_processed_at timestamp"
    rows = spark.createDataFrame([(1, "x", "[deleted]", None, None, None, None, None, None), (2, "x", "t", "c", "a", [], 77, ["OLD"], dt.datetime(2026, 1, 1))], schema)
    got = {r.id: r for r in ingest.quality_drained(rows, F.lit("2026-02-02").cast("timestamp")).collect()}
    assert got[1].quality_score == 0 and got[1].quality_flags == ["DELETED"] and got[1].dq_processed_at is not None
    assert got[2].quality_score == 77 and got[2].quality_flags == ["OLD"]
    assert ingest.quality_drained(rows.filter("false"), F.current_timestamp()).count() == 0


def test_gates_and_text_helpers(spark):
    rows = spark.createDataFrame([(None, ["DUPLICATE"]), (10, None), (40, None)], "quality_score int, quality_flags array<string>")
    assert [r.a for r in rows.select(base.loose_gate().alias("a")).collect()] == [True, False, True]
    assert len(T.TRADITIONAL) == len(T.TO_SIMPLIFIED) == len(set(T.TRADITIONAL))
    one = spark.createDataFrame([("這個 API 開源", "  ", None, "x")], "a string, b string, c string, d string")
    got = one.select(T.to_simplified(F.col("a")).alias("s"), T.first_filled(F.col("c"), F.col("b"), F.col("d")).alias("f"), T.percent(F.lit(1), F.lit(0)).alias("p"), T.percent(F.lit(1), F.lit(3)).alias("q"), T.bar(F.lit(0.5), 4).alias("bar"), T.label_of_key(F.lit(" 3"), "sentiment").alias("k")).first()
    assert tuple(got) == ("这个 API 开源", "x", "0.0%", "33.3%", "██··", "positive")


def test_statistics(spark):
    rows = spark.createDataFrame([(k, "a" if k % 2 else "b", "a" if k % 2 else "b", "a") for k in range(40)], "i bigint, t string, x string, y string")
    found = E.paired_f1_delta(rows, "t", "x", "y", 50)
    decided = E.decided(E.interval(found), "x", "y").first()
    assert found.count() == 50 and decided.decision == "x wins" and decided.low > 0.3
    assert E.decided(E.interval(E.paired_f1_delta(rows, "t", "x", "x", 20)), "x", "x").first().decision == "no winner"
    assert E.bootstrap(rows.filter("false"), F.count("*"), 5).count() == 0
    probs = spark.createDataFrame([("a", {"a": 0.7}), ("b", {"a": 0.7}), ("c", None)], "p string, m map<string,double>")
    assert [r.c for r in probs.select(E.confidence_of("p", "m").alias("c")).collect()] == [0.7, 0.7, 1.0]
    split = E.stratified_split(spark.createDataFrame([(k, "a" if k else None) for k in range(1, 41)] + [(99, "single")], "id int, l string"), "l", "id", 0.25)
    assert {(r.l, r.part): r["count"] for r in split.groupBy("l", "part").count().collect()} == {("a", "validation"): 10, ("a", "train"): 30, ("single", "train"): 1}


def test_rendering(spark):
    page = render.html_page("A & B", [("News", [("<x>", "https://e.org/?a=1&b=2"), ("y", "javascript:alert(1)"), ("z", None)])])
    assert "A &amp; B" in page and "&lt;x&gt;" in page and "javascript" not in page and 'href="https://e.org/?a=1&amp;b=2"' in page
    assert render.markdown_table(["a", "b"], [(1, None), ("x|y", "l\nm")]).splitlines()[2:] == ["| 1 |  |", "| x\\|y | l m |"]
    assert render.trend_path([0, 5, 10], 104, 54, 2, 0, 10) == "M2.0,52.0 L52.0,27.0 L102.0,2.0"
    assert render.trend_path([], 100, 50, 2, 0, 1) == "" and render.trend_path([None, 3], 104, 54, 2, 0, 0) == "M102.0,52.0"
    message = render.mail("s", "a@e.org", "b@e.org", "plain", page)
    assert [p.get_content_type() for p in message.iter_parts()] == ["text/plain", "text/html"]
    now = dt.datetime(2026, 1, 2)
    times = spark.createDataFrame([(now - dt.timedelta(days=3),), (now + dt.timedelta(minutes=90),), (now,)], "t timestamp")
    assert [r.a for r in times.select(render.relative_time(F.col("t"), F.lit(now)).alias("a")).collect()] == ["-3 day", "2 hour", "0 second"]


def test_approximate_pairs_find_nearly_all(spark):
    import numpy as np

    from sparkrill.operators import vectors as V

    rng = np.random.default_rng(5)
    base_ = rng.standard_normal((300, 32))
    rows = [(2 * k + j, (v + j * rng.standard_normal(32) * rng.uniform(0.1, 0.6)).tolist()) for k, v in enumerate(base_) for j in (0, 1)] + [(9000, [0.0] * 32)]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    want = {(r.a, r.b) for r in V.similar_pairs(frame, 0.85).collect()}
    got = {(r.a, r.b) for r in V.approximate_pairs(frame, 0.85).collect()}
    assert got <= want and len(want) > 150 and len(got) >= 0.9 * len(want)
    assert V.approximate_pairs(frame.filter("false"), 0.9).count() == 0
    assert {r.cluster for r in V.density_clusters(frame.filter("id in (0, 1, 9000)"), 0.5).collect()} == {-1}
