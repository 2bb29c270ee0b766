"""Single operators against hand-made cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkrill.functions import text as T
from sparkrill.operators import duplicates as dup
from sparkrill.operators import evaluation as E
from sparkrill.operators import faithfulness as faith
from sparkrill.operators import sentiment as mood
from sparkrill.operators import upsert as U
from sparkrill.operators import vectors as V
from sparkrill.operators.components import components
from sparkrill.operators.quality import scored
from sparkrill.operators.spikes import spikes
from sparkrill.plans import events
from sparkrill.sources import jsonl, normalise


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.Example.com/Post/?utm_source=hn&id=5#top", "example.com/Post?id=5"),
        ("http://a.org:80/x//", "a.org/x"),
        ("a.org/x?b=2&a=1", "a.org/x?a=1&b=2"),
        ("https://a.org:8443", "a.org:8443/"),
        ("mailto:a@b.c", None),
        ("javascript:void(0)", None),
        ("example.com:8080/x", None),
        ("  ", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert _one(spark, url, T.canonical_url(F.col("x"))) == want


def test_text_functions(spark):
    assert _one(spark, "ChatGPT and claude, not clauded", T.match_models(F.col("x"))) == ["gpt", "claude"]
    assert _one(spark, "用Claude寫", T.match_models(F.col("x"))) == []
    assert _one(spark, "my e-mail", T.is_ai_related(F.col("x"))) is False
    assert _one(spark, "用AI畫圖", T.is_ai_related(F.col("x"))) is True
    assert _one(spark, "Show HN: A [pdf] Tool, really!", T.normalize_title(F.col("x"))) == "a tool really"
    assert _one(spark, "一句。Two. 3.5\n!", T.split_sentences(F.col("x"))) == ["一句。", "Two.", "3."]
    assert _one(spark, "a [2][1, 2] b [3]", T.parse_citations(F.col("x"))) == [2, 1, 3]
    assert _one(spark, "a [2] b [3]", T.strip_citations(F.col("x"))) == "a b"
    assert _one(spark, "v3.5 at openai.com is out. Yes! 好。", T.split_summary(F.col("x"))) == ["v3.5 at openai.com is out", "Yes", "好"]
    assert _one(spark, "用GPT寫", T.pangu_spacing(F.col("x"))) == "用 GPT 寫"


def test_quality(spark):
    rows = [
        (1, "lobsters", "Claude compared with GPT on long context", "We compared both on forty tasks; Claude was slower, GPT was cheaper.", "ann", ["gpt", "claude"]),
        (2, "reddit", "[deleted]", "x", "a", []),
        (3, "reddit", "gpt", "", "a", ["gpt"]),
        (4, "reddit", "links", "https://a.example/aaaaaaaaaaaaaaaaaaaa https://b.example/bbbbbbbbbbbbbbbbbbbbbbb", "a", []),
        (5, "reddit", "Deal of the day for all of you", "buy now, 50% off, click here", "a", []),
        (6, "reddit", "Is there a free trial of that thing?", "I would like to know about it before I pay.", "helper_bot", []),
        (7, "threads", "gemini season", "My horoscope says Gemini and air signs rule the week", "a", ["gemini"]),
        (8, "reddit", None, None, None, None),
    ]
    got = {r.id: (r.quality_score, r.quality_flags) for r in scored(spark.createDataFrame(rows, "id int, source string, title string, content string, author string, models array<string>")).collect()}
    assert got[1] == (100, [])
    assert got[2] == (0, ["DELETED"])
    assert "TOO_SHORT" in got[3][1]
    assert "LINK_HEAVY" in got[4][1]
    assert {"SPAM_PHRASE", "AD"} <= set(got[5][1]) and got[5][0] < 30
    assert got[6][1] == ["LIKELY_BOT"]
    assert "OFF_TOPIC" in got[7][1]
    assert got[8][1] == ["TOO_SHORT"]


def _series(spark, counts):
    day = dt.date(2026, 1, 1)
    return spark.createDataFrame([("m", day + dt.timedelta(k), n) for k, n in enumerate(counts) if n], "e string, day date, n bigint")


@pytest.mark.parametrize("counts, want", [([1, 1, 1, 0, 2, 1, 0, 1, 0, 1, 1, 0, 1, 0, 12], 1), ([1] + [0] * 10 + [2], 0), ([1] + [0] * 10 + [8], 1), ([10, 10], 0), ([10] * 20, 0), ([1] + [0] * 14 + [100], 1)])
def test_spikes(spark, counts, want):
    found = spikes(_series(spark, counts), "e").collect()
    assert len(found) == want
    if counts[-1] == 100:
        assert found[0].severity == 10.0
    with pytest.raises(ValueError):
        spikes(_series(spark, counts), "e", window=3)


def test_sentiment(spark):
    rows = [("p", 0.9, 0.9, 0.05)] * 3 + [("n", 0.9, 0.05, 0.9), ("0", 0.9, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "label string, score double, p_positive double, p_negative double")
    assert df.agg(mood.index(shrink=0.0).alias("i")).first().i == 34
    one = spark.createDataFrame([(1.0, 1.0, 0.0)], "score double, p_positive double, p_negative double")
    assert one.agg(mood.index().alias("i")).first().i == 25
    assert df.filter("false").agg(mood.index().alias("i")).first().i is None


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[x] == root(x) for x in got)
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_similar_sets(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    sets = [(k, sorted(set(rng.sample(words[: rng.choice([12, 30])], rng.randrange(4, 10))))) for k in range(150)]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.6}
    got = {(r.a, r.b) for r in dup.similar_sets(spark.createDataFrame(sets, "id int, tokens array<string>"), 0.6).collect()}
    assert got == want and want


@pytest.mark.parametrize("similarity", [0.3, 0.8, 0.95])
def test_similar_sets_of_all_sizes(spark, similarity):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    sets = []
    for size in [1, 2, 4, 5, 7, 8, 9, 10, 12, 13, 14, 17, 20, 26, 33, 45, 58] * 2:
        first = rng.sample(words, size)
        for _ in range(5):
            some = set(first) ^ set(rng.sample(words, rng.randrange(0, 2 + size // 5)))
            sets.append((len(sets), sorted(some)))
    want = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= similarity}
    got = [(r.a, r.b) for r in dup.similar_sets(spark.createDataFrame(sets, "id int, tokens array<string>"), similarity).collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_similar_sets_send_nothing_through_the_driver(spark, tmp_path):
    titles = [(k, " ".join(f"w{x}" for x in [*range(8), k % 40])) for k in range(200)]
    spark.createDataFrame(titles, "id int, title string").write.parquet(str(tmp_path / "titles"))
    classes = dup.title_classes(spark.read.parquet(str(tmp_path / "titles")))
    found = dup.similar_sets(classes.filter("id = rep").select("id", "tokens"))
    assert len(found.collect()) == 32 * 31 // 2 + 32  # 32 sets with one word of their own, and the one that all the others have
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_similar_sets_of_few_words_write_few_rows(spark):
    """Titles of one build share their words with hundreds of others; what is shuffled has to follow their tokens."""
    rng = random.Random(4)
    sets = {tuple(sorted({*"why is the so".split(), *(f"{c}{rng.randrange(12)}" for c in "xyz")})) for _ in range(2000)}
    df = spark.createDataFrame([(k, list(x)) for k, x in enumerate(sorted(sets))], "id int, tokens array<string>")
    context = spark.sparkContext
    store, number = context._jsc.sc().statusStore(), context._jsc.sc().dagScheduler().nextStageId
    before, limit = number(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert dup.similar_sets(df).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    written = sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in range(before, number()))
    assert 0 < written < 4 * 7 * len(sets)


@pytest.mark.parametrize("name", ["near_dup_clusters", "duplicate_flags", "flags_written"])
def test_flags_of_posts_of_few_words_write_few_rows(spark, tmp_path, name):
    from sparkrill.plans import registry

    rng, t = random.Random(5), dt.datetime(2026, 1, 1)
    titles = sorted({" ".join(["why", "is", "the", "so", *(f"{c}{rng.randrange(12)}" for c in "xyz")]) for _ in range(2000)})
    rows = [(k, "reddit", None, x, t, 0, 0, ["SEO"]) for k, x in enumerate([*titles, titles[0] + " indeed"])]
    spark.createDataFrame(rows, "id bigint, source string, url string, title string, posted_at timestamp, score int, num_comments int, quality_flags array<string>").write.parquet(f"{tmp_path}/posts.parquet")
    context = spark.sparkContext
    store, number = context._jsc.sc().statusStore(), context._jsc.sc().dagScheduler().nextStageId
    before, limit = number(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).select("*").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    written = sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in range(before, number()))
    assert 0 < written < 60 * len(rows)
    last = len(titles)
    if name == "near_dup_clusters":
        assert sorted(got) == [(0, 0, 0), (last, 0, 0)]
    elif name == "duplicate_flags":
        assert {r[0]: r[1] for r in got} == {**{k: ["SEO"] for k in range(last)}, last: ["CANONICAL:0", "DUPLICATE", "SEO"]}
    else:
        assert got == [("reddit", 1)]


@pytest.mark.parametrize("similarity", [0.6, 0.8])
def test_linked_sets_connect_as_all_pairs(spark, similarity):
    rng = random.Random(6)
    bases = [rng.sample(range(60), rng.choice([4, 9, 12, 13, 14, 20])) for _ in range(40)]
    sets = {frozenset({*(x for x in base if rng.random() > 0.08), *rng.sample(range(60, 66), rng.randrange(2))}) for base in bases for _ in range(8)} - {frozenset()}
    ids = {k: x for k, x in enumerate(sorted(sets, key=sorted))}
    df = spark.createDataFrame([(k, [f"t{v}" for v in sorted(x)]) for k, x in ids.items()], "id bigint, tokens array<string>")
    pairs = {(a, b) for a, x in ids.items() for b, y in ids.items() if a < b and len(x & y) >= similarity * len(x | y) - 1e-9}
    links = {(r.a, r.b) for r in dup.linked_sets(df, similarity).collect()}
    assert links <= pairs

    def classes(edges):
        root = {k: k for k in ids}

        def top(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in edges:
            root[top(a)] = top(b)
        found = {}
        for k in ids:
            found.setdefault(top(k), set()).add(k)
        return {frozenset(x) for x in found.values()}

    assert classes(links) == classes(pairs)


@pytest.mark.parametrize("name", ["near_dup_clusters", "duplicate_flags", "flags_written"])
def test_posts_of_one_build_write_few_rows(spark, tmp_path, name):
    from sparkrill.plans import registry

    t, n = dt.datetime(2026, 1, 1), 400
    rows = [(k, "reddit", None, f"we renamed our old migration plan with the slow gate {k}", t, 0, 0, ["SEO"]) for k in range(n)]
    spark.createDataFrame(rows, "id bigint, source string, url string, title string, posted_at timestamp, score int, num_comments int, quality_flags array<string>").write.parquet(f"{tmp_path}/posts.parquet")
    context = spark.sparkContext
    store, number = context._jsc.sc().statusStore(), context._jsc.sc().dagScheduler().nextStageId
    before, limit = number(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    written = sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in range(before, number()))
    assert 0 < written < 150 * n  # their pairs alone are 200 times the posts
    if name == "near_dup_clusters":
        assert sorted(got) == [(k, 0, 0) for k in range(n)]
    elif name == "duplicate_flags":
        assert {r[0]: r[1] for r in got} == {0: ["SEO"], **{k: ["CANONICAL:0", "DUPLICATE", "SEO"] for k in range(1, n)}}
    else:
        assert got == [("reddit", n - 1)]


def test_duplicate_flags_shuffle_in_rounds(spark, tmp_path, monkeypatch):
    """No stage shuffles the keys of all sets at once, and what found the clusters is deleted."""
    from pathlib import Path

    from sparkrill.plans import registry
    from sparkrill.storage import shared_dir

    monkeypatch.setattr(dup, "ROUND", 100, raising=False)
    t, n = dt.datetime(2026, 1, 1), 600
    rows = [(k, "reddit", f"https://a.example/{k // 2}" if k > n else None, f"we renamed our old migration plan with the slow gate {k}" if k < n else "short", t, 0, 0, ["SEO"]) for k in range(n + 4)]
    spark.createDataFrame(rows, "id bigint, source string, url string, title string, posted_at timestamp, score int, num_comments int, quality_flags array<string>").write.parquet(f"{tmp_path}/posts.parquet")
    context, folder = spark.sparkContext, Path(shared_dir(spark).removeprefix("file://"))
    store, number = context._jsc.sc().statusStore(), context._jsc.sc().dagScheduler().nextStageId
    before, limit, there = number(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), {*folder.iterdir()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.id: r.quality_flags for r in registry.queries()["duplicate_flags"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < max(store.lastStageAttempt(k).shuffleWriteRecords() for k in range(before, number())) < 20 * n  # a set has 79 keys
    assert {x.name.rsplit("-", 1)[0] for x in {*folder.iterdir()} - there} <= {"components", "clusters", "picked"}
    double = ["CANONICAL:0", "DUPLICATE", "SEO"]
    assert got == {0: ["SEO"], **{k: double for k in range(1, n)}, n: ["SEO"], n + 1: ["SEO"], n + 2: ["SEO"], n + 3: [f"CANONICAL:{n + 2}", "DUPLICATE", "SEO"]}


def test_linked_sets_in_rounds_connect_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dup, "ROUND", 20)
    rng = random.Random(8)
    bases = [rng.sample(range(60), rng.choice([4, 9, 12, 13, 14, 20])) for _ in range(30)]
    sets = {frozenset(x for x in base if rng.random() > 0.06) for base in bases for _ in range(6)} - {frozenset()}
    df = spark.createDataFrame([(k, [f"t{v}" for v in sorted(x)]) for k, x in enumerate(sorted(sets, key=sorted))], "id bigint, tokens array<string>")
    got, want = ({(r.id, r.component) for r in components(edges).collect()} for edges in (dup.linked_sets(df), dup.similar_sets(df)))
    assert got == want and len(want) > 20


def test_written_tables_leave_no_shuffles(spark):
    from pathlib import Path

    from sparkrill.storage import drop_table, written

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {x.rsplit("/", 1)[-1] for x in blocks.getAllFiles().mkString("\n").split("\n") if x.endswith(".data")}

    before = shuffles()
    table = written(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count(), "left")
    assert shuffles() <= before
    files = [Path(f.removeprefix("file://")) for f in table.inputFiles()]
    assert table.count() == 10 and files and all(f.exists() for f in files)
    drop_table(table)
    assert not any(f.exists() for f in files)


def test_duplicates(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [
        (1, "reddit", "https://a.example/x?utm_source=b", "First title of a story here", t, 5, 0, ["SEO", "DUPLICATE", "CANONICAL:9"]),
        (2, "hackernews", "https://www.a.example/x/", "Another one altogether my friends", t, 5, 0, None),
        (3, "devto", None, "another ONE altogether my friends!", t - dt.timedelta(1), 0, 0, []),
        (4, "devto", None, "short title", t, 0, 0, []),
        (5, "devto", None, "short title", t, 0, 0, []),
    ]
    posts = spark.createDataFrame(rows, "id bigint, source string, url string, title string, posted_at timestamp, score int, num_comments int, quality_flags array<string>")
    picked = dup.canonicals(posts, dup.clusters(posts))
    assert {(r.id, r.canonical_id) for r in picked.collect()} == {(1, 3), (2, 3), (3, 3)}
    flags = dup.reconciled_flags(posts, picked)
    got = {r.id: r.quality_flags for r in flags.collect()}
    assert got[1] == ["CANONICAL:3", "DUPLICATE", "SEO"] and got[3] == [] and got[4] == []
    again = dup.reconciled_flags(flags, picked)
    assert {r.id: r.quality_flags for r in again.collect()} == got


@pytest.mark.parametrize("b, c, statistic, p", [(3, 1, 1, 0.625), (5, 0, 0, 0.0625), (20, 6, 6.5, 0.010787), (0, 0, 0, 1.0)])
def test_mcnemar(spark, b, c, statistic, p):
    got = E.mcnemar_of(spark.createDataFrame([(b, c)], "b bigint, c bigint")).first()
    assert got.statistic == pytest.approx(statistic) and got.p == pytest.approx(p, abs=1e-6)


def test_statistics(spark):
    ps = spark.createDataFrame([("a", 0.001), ("b", 0.01), ("c", 0.04), ("d", 0.5)], "name string, p double")
    assert [round(r.p_adjusted, 4) for r in E.benjamini_hochberg(ps).orderBy("p").collect()] == [0.004, 0.02, 0.0533, 0.5]
    same = spark.createDataFrame([("x", "x")] * 4, "a string, b string")
    assert E.kappa(same, "a", "b").first()["kappa"] == 1.0
    assert E.kappa(same.filter("false"), "a", "b").first()["kappa"] == 1.0
    rows = spark.createDataFrame([(k, k / 10, k % 2 == 0) for k in range(1, 11)], "id int, confidence double, correct boolean")
    curve = {r["rank"]: r.risk for r in E.risk_coverage(rows, "confidence", "correct", "id").collect()}
    assert curve[1] == 0 and curve[2] == 0.5 and curve[10] == 0.5


def test_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id bigint, v array<double>")
    assert {(r.id, r.cluster) for r in V.threshold_clusters(vectors, 0.7).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert V.threshold_clusters(vectors, 0.8).count() == 0
    assert V.threshold_clusters(vectors, 0.8, min_size=1).count() == 4
    assert {(r.a, r.b) for r in V.similar_pairs(vectors, 0.7, block=1).collect()} == {(0, 1), (1, 2)}
    grouped = vectors.withColumn("g", F.lit("g"))
    assert [r.id for r in V.mmr(grouped, "g", 3).orderBy("place").collect()][0] == 1


def test_faithfulness(spark):
    df = spark.createDataFrame([(1, "Cats sleep [1]。Dogs bark loudly [3]", ["cats sleep a lot", "dogs bark"])], "id int, summary string, sources array<string>")
    parts = faith.sentences(df).withColumn("entailment", faith.word_overlap(F.col("premise"), F.col("hypothesis"))).withColumn("contradiction", F.lit(0.0))
    got = faith.report(parts, df.select("id", F.size("sources").alias("n_sources"))).first()
    assert got.validity == 0.5 and got.coverage == 0.5 and got.entailed == 1.0
    assert got.score == pytest.approx(0.5 + 0.1 + 0.075 + 0.15)


def test_upsert(spark, tmp_path):
    schema = "source string, external_id string, title string, posted_at timestamp, score int, fetched_at int"
    t = dt.datetime(2026, 1, 1)
    table = U.Snapshots(spark, str(tmp_path / "posts"), schema)
    batch = spark.createDataFrame([("r", "a", "A", t, 1, 1), ("r", "a", "A2", t, 999, 2), ("r", "b", None, t, 1, 1)], schema)
    assert table.upsert(batch, U.KEY, ["title", "score"], U.REQUIRED, F.col("fetched_at")) == 1
    assert [(r.title, r.score) for r in table.read().collect()] == [("A2", 999)]
    table.upsert(batch, U.KEY, ["title", "score"], U.REQUIRED, F.col("fetched_at"))
    assert table.read().count() == 1 and table.version() == 2
    links = spark.createDataFrame([(1, "gpt"), (1, "gpt"), (1, "nope"), (2, "gpt")], "post_id bigint, slug string")
    dim, stored = spark.createDataFrame([(1, "gpt")], "id int, slug string"), spark.createDataFrame([(2, 1)], "post_id bigint, model_id int")
    assert [tuple(r) for r in U.new_links(links, stored, dim).collect()] == [(1, 1)]


def test_reconcile_keeps_all_on_an_empty_run(spark):
    schema = "dedup_key string, event_type string"
    stored = spark.createDataFrame([("a", "launch"), ("b", "manual")], schema)
    assert events.reconciled(stored, stored.filter("false")).count() == 2
    found = spark.createDataFrame([("c", "launch")], schema)
    assert {r.dedup_key for r in events.reconciled(stored, found).collect()} == {"b", "c"}


def test_sources(spark, tmp_path):
    raw = [{"objectID": "1", "title": "GPT", "points": None, "created_at_i": 0}, {"objectID": None, "title": None, "created_at_i": 1767225600}]
    path = tmp_path / "hn.json"
    path.write_text("\n".join(map(json.dumps, raw)) + "\nbroken\n")
    rows = normalise.posts_of("hackernews", normalise.landed(spark, "hackernews", str(path))).collect()
    assert rows[0].score == 0 and rows[0].posted_at is None and rows[0].models == ["gpt"] and rows[1].external_id is None
    for source in normalise.RAW:
        empty = spark.createDataFrame([], normalise.RAW[source])
        assert normalise.posts_of(source, empty).columns == normalise.POST_COLUMNS
    board = spark.createDataFrame([("b", "1", "AI 爆", "x", "a", None, n, None, "2026-01-01T00:00:00Z") for n in ("爆", "X1", "12", "")], normalise.RAW["ptt"])
    assert [r.score for r in normalise.posts_of("ptt", board).collect()] == [100, -10, 12, 0]
    models = spark.createDataFrame([("google/gemma-3", "2026-01-01T00:00:00Z", 1, 1, None, None, None), ("google/bert", "2026-01-01T00:00:00Z", 1, 1, None, None, None)], normalise.RELEASES_RAW["huggingface"])
    assert [(r.model, r.title) for r in normalise.releases_of("huggingface", models).collect()] == [("gemini", "gemma-3")]
    windows = normalise.backfill_windows(spark, "2026-01-15", "2026-03-10").collect()
    assert [(w.start.month, w.end.day) for w in windows] == [(1, 1), (2, 1), (3, 10)]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    path.write_text('{"event_id": 7, "title": "a", "summary": "s", "citations": [{"url": "u"}], "theme": "?"}\n\nbroken\n{"summary": null}\n{"summary": "t"}\n')
    rows = jsonl.served_events(spark, str(path)).collect()
    assert [(r.id, r.summary, r.theme) for r in rows] == [("7", "s", "其他"), ("5", "t", "其他")]
    assert rows[0].citations[0].n == 1
    assert jsonl.served_events(spark, str(tmp_path / "none")).count() == 0
    assert jsonl.read_jsonl(spark, str(path), "title string").count() >= 1
    scores = tmp_path / "s.jsonl"
    scores.write_text('{"event_id": "a", "faithfulness": 0.1}\n{"event_id": "a", "faithfulness_score": "0.5"}\n{"event_id": "b"}\n')
    assert [tuple(r) for r in jsonl.score_file(spark, str(scores)).collect()] == [("a", 0.5)]
