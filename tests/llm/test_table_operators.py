"""Operators on tables against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkrill.llm import accounts, bisect, byte_bpe, confusables, contributor_cap, group_split, history_dedup, langid, lsh_forest, mixing, residue, stored, truncation
from sparkrill import storage
from sparkrill.llm.shingles import bigram_sets, overlap, shingles, tokens
from sparkrill.tables import table
from tests.conftest import SMALL

POSTS = "id bigint, source string, external_id string, title string, content string, author string, fetched_at timestamp, quality_score int, tree int, bag int, cap int, n int, _batch string"


def _post(i, content=None, author=None, source="reddit", external=None, day=1, score=None, title=None):
    return (i, source, external or f"e{i}", title, content, author, dt.datetime(2026, 3, day, 12), score, 1, 1, 1, 1, "x")


@pytest.fixture(scope="module")
def same(spark):
    """Pairs of the smallest posts with the same text, by comparing all with all."""
    rows = table(spark, SMALL, "posts").filter("length(content) >= 80").select("id", "content", F.to_date("fetched_at").alias("day")).collect()
    hashes, _, offsets = tokens([r.content for r in rows])
    bags = bigram_sets(hashes, offsets)
    pairs = {(min(a.id, b.id), max(a.id, b.id)) for k, a in enumerate(rows) for j, b in enumerate(rows[:k]) if overlap(bags[k], bags[j]) >= 0.5}
    return pairs, {r.id: r.day for r in rows}


def test_near_duplicates_against_all_pairs(spark, same):
    got = {(r.id_a, r.id_b) for r in lsh_forest.same_text_pairs(table(spark, SMALL, "posts"), "id", "content").collect()}
    assert got == same[0] and got


def test_history_against_all_pairs(spark, same):
    pairs, day = same
    want = {max((day[a], a), (day[b], b))[1] for a, b in pairs if day[a] != day[b]}
    found = [r.id for r in history_dedup.repeats(table(spark, SMALL, "posts"), "id", "content", "fetched_at").collect()]
    assert set(found) == want and len(found) == len(want) and want


TEXT = "Around midnight our librarian compared forty long answers side by side and found that the second model kept the table intact while the first one forgot it"


def test_near_duplicates_of_special_rows(spark):
    rows = [_post(1, TEXT), _post(2, TEXT.upper() + "!"), _post(3, TEXT.replace("forty", "fifty")), _post(4), _post(5, ""), _post(6, "short"), _post(7, "🎉" * 100), _post(8, TEXT * 400)]
    posts = spark.createDataFrame(rows, POSTS)
    got = {(r.id_a, r.id_b) for r in lsh_forest.same_text_pairs(posts, "id", "content").collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
    assert lsh_forest.same_text_pairs(posts.filter("false"), "id", "content").count() == 0


def test_dense_region_loses_no_link(spark):
    words = TEXT.split()
    rows = [_post(k, " ".join([*words, f"number {k}"])) for k in range(90)]
    pairs = lsh_forest.same_text_pairs(spark.createDataFrame(rows, POSTS), "id", "content", dense=8)
    assert pairs.distinct().count() == 90 * 89 // 2


def _edited(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def test_near_duplicates_reworded_in_pairs(spark):
    """Groups of two with one-word substitutions all over, by similarity against brute force."""
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(600):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 120))]
        rows += [_post(2 * k, " ".join(words)), _post(2 * k + 1, " ".join(_edited(rng, words, rng.uniform(0.03, 0.16))))]
        hashes, _, offsets = tokens([rows[-2][4], rows[-1][4]])
        want[2 * k, 2 * k + 1] = overlap(*bigram_sets(hashes, offsets))
    got = {(r.id_a, r.id_b) for r in lsh_forest.same_text_pairs(spark.createDataFrame(rows, POSTS), "id", "content").collect()}
    assert got <= {p for p, j in want.items() if j >= 0.5}
    for low, high, least in ((0.6, 0.65, 0.97), (0.65, 0.72, 0.99), (0.72, 1, 1)):
        band = {p for p, j in want.items() if low <= j < high}
        assert len(band) > 30 and len(band & got) >= least * len(band), (low, len(band & got), len(band))


def test_near_duplicates_down_to_the_threshold(spark):
    """Groups of two that have 0.5 to 0.6 in common: at least 0.9 of them."""
    rng = random.Random(17)
    rows, want = [], set()
    for k in range(500):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 200))]
        rows += [_post(2 * k, " ".join(words)), _post(2 * k + 1, " ".join(_edited(rng, words, rng.uniform(0.13, 0.18))))]
        hashes, _, offsets = tokens([rows[-2][4], rows[-1][4]])
        if 0.5 <= overlap(*bigram_sets(hashes, offsets)) < 0.6:
            want.add((2 * k, 2 * k + 1))
    got = {(r.id_a, r.id_b) for r in lsh_forest.same_text_pairs(spark.createDataFrame(rows, POSTS), "id", "content").collect()}
    assert len(want) > 150 and len(want & got) >= 0.9 * len(want), (len(want & got), len(want))


def test_dense_region_of_different_copies(spark):
    """All pairs of a cluster of edited copies that many signature orders hold side by side."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = [_post(k, " ".join(_edited(rng, base, 0.06))) for k in range(300)]
    hashes, _, offsets = tokens([r[4] for r in rows])
    bags = bigram_sets(hashes, offsets)
    want = {(a, b) for b in range(300) for a in range(b) if overlap(bags[a], bags[b]) >= 0.5}
    for dense, least in ((8, 0.99), (256, 1)):
        got = {(r.id_a, r.id_b) for r in lsh_forest.same_text_pairs(spark.createDataFrame(rows, POSTS), "id", "content", dense=dense).collect()}
        assert got <= want and len(got) >= least * len(want), (dense, len(got), len(want))


def test_large_cluster_in_linear_work(spark):
    """20,000 texts one word apart are one class, with a number of candidates that grows with the texts and not with their pairs."""
    base = [f"w{k}" for k in range(80)]
    rows = spark.range(20_000, numPartitions=8).select("id", F.concat_ws(" ", F.lit(" ".join(base[:40])), F.concat(F.lit("x"), "id"), F.lit(" ".join(base[40:]))).alias("content"))
    rows = rows.unionByName(spark.createDataFrame([(30_000, " ".join(f"v{k}" for k in range(80)))], "id bigint, content string"))
    forest = lsh_forest.Forest(rows, "id", "content", trees=8)
    assert forest.edges.count() < 8 * 20_000 * (2 * lsh_forest.NEAR + 2)
    assert {tuple(r) for r in forest.classes().groupBy("class").count().collect()} == {(0, 20_000), (30_000, 1)}


def test_history_over_several_calls(spark):
    posts = spark.createDataFrame([_post(1, TEXT, day=1), _post(2, TEXT, day=1), _post(3, TEXT + " again", day=2), _post(4, TEXT, day=3), _post(5, None, day=3), _post(6, "other " * 40, day=3)], POSTS).withColumn("_day", F.dayofmonth("fetched_at"))
    history = history_dedup.History(spark, partitions=3)
    found = [{r.id for r in history.admit(posts.filter(F.col("_day") == d), "id", "content", "_day").collect()} for d in (1, 2, 3)]
    assert found == [set(), {3}, {4}]
    assert history.admit(posts.filter("false"), "id", "content", "_day").count() == 0
    assert history_dedup.repeats(posts.filter("false"), "id", "content", "fetched_at").count() == 0


def test_history_of_reopened_stores(spark):
    """Ten daily batches through ten stores that are opened anew give what one call gives; so does a compacted store, and a call that failed leaves no trace."""
    rng = random.Random(21)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(15, 80))) for _ in range(120)]
    rows = []
    for k in range(400):
        words = rng.choice(texts).split()
        rows.append(_post(k, " ".join(words if rng.random() < 0.3 else _edited(rng, words, 0.04)), day=1 + k * 10 // 400))
    posts = spark.createDataFrame(rows, POSTS).withColumn("_day", F.dayofmonth("fetched_at")).cache()
    want = {r.id for r in history_dedup.repeats(posts, "id", "content", "fetched_at", calls=1).collect()}
    folder, got = storage.new_folder(spark, "test-history"), set()
    for day in range(1, 11):
        own = posts.filter(F.col("_day") == day)
        history = history_dedup.History(spark, folder, partitions=3)
        if day == 5:
            with pytest.raises(Exception):
                history.admit(own.withColumn("content", F.raise_error(F.lit("broken"))), "id", "content", "_day")
        if day == 7:
            history.compact()
        got |= {r.id for r in history_dedup.History(spark, folder).admit(own, "id", "content", "_day").collect()}
    assert got == want and len(want) > 150
    assert len(history_dedup.History(spark, folder).manifest["texts"]) == 10


def test_history_finds_the_copy_of_a_digest(spark):
    """Each fingerprint of the digest was held before by a post of its own; the digest's exact and edited copies are found all the same."""
    parts = [" ".join(f"p{k}w{j}" for j in range(30)) for k in range(5)]
    texts = parts + [" ".join(parts)] * 2 + [" ".join(parts).replace("w7 ", "w7x ")]
    posts = spark.createDataFrame([_post(k, t, day=1 + max(0, k - 4)) for k, t in enumerate(texts)], POSTS)
    for calls in (1, 4):
        assert {r.id for r in history_dedup.repeats(posts, "id", "content", "fetched_at", calls=calls).collect()} == {6, 7}


def test_history_with_a_fingerprint_of_very_many(spark):
    """A frame in more posts than a rare fingerprint has, as a small and as the greater part of the texts, against all pairs."""
    rng = random.Random(22)
    rows = []
    for size, frame in ((30, [f"f{j}" for j in range(25)]), (22, [f"g{j}" for j in range(40)])):
        for _ in range(150):
            own = [f"u{rng.randrange(10**6)}" for _ in range(size)]
            text = frame[:20] + own + frame[20:]
            rows.append(text)
            if rng.random() < 0.3:
                rows.append([w if w in frame or rng.random() > 0.08 else "e" + w for w in text])
    rng.shuffle(rows)
    posts = [_post(k, " ".join(r), day=1 + k % 6) for k, r in enumerate(rows)]
    hashes, _, offsets = tokens([r[4] for r in posts])
    bags = bigram_sets(hashes, offsets)
    want = {b for b in range(len(posts)) if any(posts[a][6] < posts[b][6] and overlap(bags[a], bags[b]) >= 0.5 for a in range(len(posts)))}
    frame = spark.createDataFrame(posts, POSTS)
    for calls in (1, 2):
        got = {r.id for r in history_dedup.repeats(frame, "id", "content", "fetched_at", calls=calls).collect()}
        assert got <= want and len(got) >= 0.97 * len(want) > 30, (len(got), len(want))


def test_history_goes_through_common_fingerprints_in_rounds(spark, monkeypatch):
    """Posts of one frame have holders by its square; what is shuffled at once stays bounded, and the pairs are the same."""
    rng = random.Random(8)
    words = [" ".join([*(f"g{j}" for j in range(40)), *(f"w{rng.randrange(10**6)}" for _ in range(8))]) for _ in range(300)]
    frame = spark.createDataFrame([(k, text, k % 3) for k, text in enumerate(words)], "id bigint, content string, day int")
    real, rounds, found = history_dedup.History._common, [], []

    def common(*args):
        rounds.append(real(*args))
        assert all(len(table.inputFiles()) for table in rounds[-1])
        seen.append({(r.x, r.y) for table in rounds[-1] for r in table.collect()})
        return rounds[-1]

    monkeypatch.setattr(history_dedup.History, "_common", common)
    monkeypatch.setattr(history_dedup, "_HELD", 1)
    seen = []
    for per_text in (10**6, 100):
        monkeypatch.setattr(history_dedup, "_HELD_PER_TEXT", per_text)
        got = history_dedup.History(spark, partitions=3).admit(frame, "id", "content", "day").collect()
        found.append({r.id for r in got})
    assert found[0] == found[1] == set(range(1, 300)) - {k for k in range(300) if k % 3 == 0}
    assert len(rounds[0]) == 1 and len(rounds[1]) > 5 and seen[0] == seen[1] and len(seen[0]) > 10_000


def test_history_leaves_holders_that_share_too_little_where_they_are(spark, monkeypatch):
    """Texts of the same sentences, of which any two have few: all texts that share enough are judged, and the others are not shuffled."""
    import numpy as np

    rng = random.Random(3)
    sentences = [" ".join(f"s{k}w{j}" for j in range(20)) for k in range(100)]
    texts = [" ".join(rng.sample(sentences, 12)) for _ in range(600)]
    texts += [t.replace("w7 ", "w8 ", 2) for t in texts[:20]]
    posts = spark.createDataFrame([(k, t, k // 200) for k, t in enumerate(texts)], "id bigint, content string, day int")
    real, tables, at = history_dedup.History._common, [], {}

    def common(self, judged, token, *args):
        tables.extend(real(self, judged, token, *args))
        at.update({r.loc: r.id for r in spark.read.parquet(f"{self.folder}/texts/{token}").collect()})
        got.update((at[r.x], at[r.y]) for table in tables for r in table.collect())
        return tables

    monkeypatch.setattr(history_dedup.History, "_common", common)
    monkeypatch.setattr(history_dedup, "_HELD", 1 << 10)
    monkeypatch.setattr(history_dedup, "_HELD_PER_TEXT", 10)
    got = set()
    found = {r.id for r in history_dedup.History(spark, partitions=3).admit(posts, "id", "content", "day").collect()}
    assert found == set(range(600, 620)) and len(tables) < 12

    values, places = shingles(*tokens(texts), history_dedup.WORDS, history_dedup.CHARACTERS)
    prints, doc = history_dedup.winnow(values & ~np.uint64(1), places)
    sets = [prints[doc == k].view(np.int64).tolist() for k in range(len(texts))]
    count = Counter(p for s in sets for p in s)
    want = set()
    for x, own in enumerate(sets):
        hot = sorted((count[p], p) for p in own if count[p] > history_dedup.COMMON)
        if len(hot) < len(own) / 2:
            continue
        share = -(-len(hot) // 2)
        asked = {p for _, p in hot[: len(hot) - share + min(share, 3)]}
        want |= {(x, y) for y in range(x // 200 * 200) if len(asked & set(sets[y])) >= min(share, 3)}
    assert got == want and len(want) > 20


def test_pieces_of_sorted_files(tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(stored, "PIECE", 10)
    values = np.sort(np.repeat(np.arange(12), [1, 3, 30, 2, 2, 9, 9, 1, 1, 1, 25, 1]))
    pq.write_table(pa.table({"k": values, "v": np.arange(len(values))}), f"{tmp_path}/part-00000-a.parquet", row_group_size=7)
    part = stored.Part(stored.files_in(str(tmp_path), "."))
    pieces = list(part.sorted_pieces(["k", "v"], "k"))
    assert np.concatenate([p[1] for p, _ in pieces]).tolist() == list(range(len(values)))
    for (first, whole), (second, _) in zip(pieces, pieces[1:]):
        assert not whole or first[0][-1] != second[0][0]
    assert part.among("k", np.array([3, 11]), ["k", "v"])[0].tolist() == [3, 3, 11]
    assert stored.files_in(str(tmp_path), "none") == []


def test_history_behind_a_common_frame(spark):
    """Z brings the frame and holds most prints of X, which repeats Y: Y, the first holder of few of them, is compared all the same."""

    def prints(text):
        hashes, alone, offsets = tokens([text])
        return set(history_dedup.winnow(*shingles(hashes, alone, offsets, history_dedup.WORDS, history_dedup.CHARACTERS))[0].tolist())

    for seed in range(1000):
        rng = random.Random(seed)
        frame, z, y = ([f"{name}{rng.randrange(10**6)}" for _ in range(size)] for name, size in (("f", 40), ("z", 60), ("y", 60)))
        x = [f"x{k}" if k % 9 == 4 else w for k, w in enumerate(y)]
        texts = [" ".join(frame + own) for own in (z, y, x)]
        hashes, _, offsets = tokens(texts)
        bags = bigram_sets(hashes, offsets)
        pz, py, px = map(prints, texts)
        if 0 < len((px & py) - pz) < 0.2 * len(px) <= len(px & pz) and overlap(bags[1], bags[2]) >= 0.55 and overlap(bags[0], bags[2]) < 0.45:
            break
    else:
        raise AssertionError("no such texts")
    posts = spark.createDataFrame([_post(k + 1, text, day=k + 1) for k, text in enumerate(texts)], POSTS)
    for calls in (1, 3):
        assert [(r.id, r.first_id) for r in history_dedup.repeats(posts, "id", "content", "fetched_at", calls=calls).collect()] == [(3, 2)]


def test_bisection_against_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randrange(-5, 5) * 10**15, rng.choice([None, 1, 3])) for _ in range(300)] + [(None, 1, 1), ("a", None, 1)]
    needs = [("a", 40), ("b", 1), ("c", 3), ("b", 0)]
    got = {r.g: (r.cutoff, r.below, r.at) for r in bisect.cutoffs(spark.createDataFrame(rows, "g string, v bigint, w int"), spark.createDataFrame(needs, "g string, need bigint"), "g", "v", "w", 4).collect()}
    for g, need in needs[:2]:
        total = 0
        for v in sorted({r[1] for r in rows if r[0] == g and r[1] is not None}):
            at = sum(r[2] or 0 for r in rows if r[0] == g and r[1] == v)
            if total + at >= need:
                assert got[g] == (v, total, at)
                break
            total += at
    assert set(got) == {"a", "b"}


def test_accounts(spark):
    rows = [("@Ann", "reddit"), ("ａｎｎ", "X"), ("u/ann ", "x"), ("/u/ann\n", "x"), ("an​n", "x"), ("ann (夜貓子)", "x"), (None, "Threads@ann"), ("[deleted]", "threads@Ann"), ("", "x"), ("[deleted]", "x"), (None, None), ("an_n", "x"), ("an-n", "x")]
    got = [r.a for r in spark.createDataFrame(rows, "author string, source string").select(accounts.account(F.col("author"), F.col("source")).alias("a")).collect()]
    assert got == ["ann"] * 8 + [None, None, None, "an_n", "an-n"]


def test_caps(spark):
    caps = spark.createDataFrame([("reddit", 2), ("x", 1), ("ptt", None)], "source string, max_posts int")
    rows = [_post(1, author="a", score=5), _post(2, author="@A", score=5), _post(3, author="a", score=5), _post(4, author="a", score=9), _post(5, author="a"), _post(6), _post(7), _post(8), _post(9, author="b", external="z", day=1), _post(10, author="b", external="z", day=2), _post(11, author="b"), _post(12, author="b"), _post(13, author="a", source="ptt"), _post(14, author="c", source="x"), _post(15, author="c", source="X ", score=0)]
    posts = spark.createDataFrame(rows, POSTS)
    assert {r.id for r in contributor_cap.dropped_posts(posts, caps).collect()} == {2, 3, 5, 12, 14}
    assert contributor_cap.dropped_posts(posts.filter("false"), caps).count() == 0
    assert contributor_cap.dropped_posts(posts, caps.filter("false")).count() == 0
    shares = spark.createDataFrame([(k, "a" if k < 8 else "b", k % 3, None) for k in range(10)], "id bigint, contributor string, score int, cap int")
    assert contributor_cap.capped(shares, max_share=0.4).filter("kept and contributor = 'a'").count() == 4


def test_splits(spark):
    rows = [_post(k, author="hot" if k < 100 else f"u{k % 57}" if k < 300 else None) for k in range(1000)]
    posts = spark.createDataFrame(rows, POSTS)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    got = group_split.post_splits(posts, targets).collect()
    assert len(got) == 1000
    by = {}
    for r in got:
        if r.account:
            by.setdefault(r.account, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    sizes = {s: sum(r.split == s for r in got) for s in ("train", "validation", "test")}
    assert abs(sizes["validation"] - 100) <= 10 and abs(sizes["test"] - 100) <= 10
    assert group_split.post_splits(posts.filter("false"), targets).count() == 0
    assert {(r.first_id, r.id) for r in group_split.account_members(posts.filter("id in (1, 2, 300, 301)"), targets).collect()} == {(1, 2)}


def test_large_accounts_are_in_the_flow():
    """Few large components of all sizes: the splits come as near as whole ones allow."""
    bundles = [(k, "ab"[k % 2], 1, n) for k, n in enumerate((400, 220, 130, 90, 70, 50, 30, 10))] + [(8, "a", 40, 80)]
    plan = group_split.quotas(bundles, [0.8, 0.1, 0.1])
    assert [sum(p) for p in plan] == [b[2] for b in bundles]
    reached = [sum(p[s] * b[3] // b[2] for p, b in zip(plan, bundles)) for s in range(3)]
    assert sum(reached) == 1080 and abs(reached[0] - 864) <= 40 and min(reached[1:]) >= 60
    assert group_split.quotas([(0, "a", 1, 5)], [0.0, 1.0]) == [[0, 1]]


def test_records_joined_over_several_keys(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "x"), (4, "b", "y"), (5, None, None), (6, None, "y"), (7, "x", None)], "id bigint, author string, entity string")
    found = {r.id: r.key for r in group_split.joined_keys(rows, "id", ["author", "entity"]).collect()}
    assert found[1] == found[2] == found[3] and found[4] == found[6] != found[1] and found[5] is None and found[7] not in (found[1], found[4], None)


def test_truncated(spark):
    rng = random.Random(3)
    nouns, verbs = [f"noun{c}" for c in "abcdefghij"], ["moves", "likes", "breaks", "keeps"]

    def text(n):
        return " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} the old {rng.choice(nouns)} near town." for _ in range(n))

    rows = [_post(k, text(rng.randrange(3, 9)), source="devto") for k in range(300)]
    rows += [_post(1000 + k, text(9)[:280], source="x") for k in range(60)]
    rows += [_post(2000, text(3) + " The nouna likes the", source="devto"), _post(2001, text(3).rstrip("."), source="devto"), _post(2002, "lol", source="devto"), _post(2003, None, source="devto"), _post(2004, "", source="devto"), _post(2005, text(3) + " The nounb brea", source="devto")]
    posts = spark.createDataFrame(rows, POSTS)
    contents = {r[0]: r[4] for r in rows}
    gold = spark.createDataFrame([(5, "devto", 1, "t. " + contents[5]), (6, "devto", 2, ("t. " + contents[6])[:60]), (1001, "x", 1, "t. " + contents[1001]), (9999, "x", 1, "Alone and whole."), (5, "devto", 3, None)], "post_id bigint, source string, round int, text string")
    posts = posts.withColumn("title", F.lit("t"))
    got = {(r.record_table, r.post_id, r.round) for r in truncation.truncated(posts, gold).collect()}
    want = {("posts", r[0], 0) for r in rows if 1000 <= r[0] < 2000 and not r[4].endswith(".")} | {("posts", 2000, 0), ("posts", 2005, 0), ("gold_labels", 6, 2)}
    want |= {("gold_labels", 1001, 1)} if not contents[1001].endswith(".") else set()
    assert got == want
    assert truncation.truncated(posts.filter("false"), gold.filter("false")).count() == 0


def test_words_cut_in_the_middle_and_greetings(spark):
    """A last word that begins many others and is hardly ever whole is cut, even where cut marks made it look like an end; a greeting and a whole word are ends."""
    rng = random.Random(31)
    subjects, verbs = ["editor", "maintainer", "student", "colleague"], ["reviews", "merges", "tests"]

    def text(n):
        return " ".join(f"The {rng.choice(subjects)} {rng.choice(verbs)} the {rng.choice(['document', 'documents', 'summary'])} with the {rng.choice(['manager', 'model', 'models'])}." for _ in range(n))

    rows = [_post(k, text(rng.randrange(3, 8)), source="devto") for k in range(300)]
    rows += [_post(400 + k, text(3) + rng.choice(["\ncheers", " cheers"]), source="devto") for k in range(30)] + [_post(430, "Cheers from the road, friends. " + text(2), source="devto")] * 3
    rows += [_post(500 + k, text(2) + " Then the editor tests the docum...", source="devto") for k in range(4)]
    rows += [_post(600, text(3) + " Then the student merges the docum", source="devto"), _post(601, text(3) + " The editor reviews the summary with the model", source="devto")]
    posts = spark.createDataFrame(rows, POSTS).withColumn("title", F.lit("t"))
    gold = spark.createDataFrame([], "post_id bigint, source string, round int, text string")
    got = {r.post_id for r in truncation.truncated(posts, gold).collect()}
    assert 600 in got and 601 not in got and not {k for k in got if k < 500}


def test_languages(spark):
    posts, labels = table(spark, SMALL, "posts"), table(spark, SMALL, "post_langs")
    sample = langid.labelled_sample(posts, labels)
    dictionaries = langid.fit(sample)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ok"), (4, "Has anyone else noticed that the long answers are slower than before? " * 3000)], "id bigint, text string")
    got = {r.id: r.lang for r in langid.languages(odd, "id", "text", dictionaries).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "en"}
    found = langid.languages(posts.filter("length(content) >= 80"), "id", "content", dictionaries)
    right = found.join(labels.select(F.col("post_id").alias("id"), langid.language_of_label(F.col("lang")).alias("label")).filter("label is not null"), "id")
    assert right.agg(F.avg((F.col("lang") == F.col("label")).cast("double"))).first()[0] > 0.85
    assert langid.relabelled(posts.filter("false"), labels).count() == 0
    assert langid.relabelled(posts.limit(5), labels.filter("false")).count() == 0


def test_ids_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "hello world", 1), (3, "hello world", 1)], "doc_id bigint, text string, ids int")
    assert [r.ids for r in byte_bpe.encoded(docs).orderBy("doc_id").collect()] == [[], [], [31373, 995], [31373, 995]]
    assert byte_bpe.encoded(docs.filter("false")).count() == 0


def test_affected_fields(spark):
    rows = [_post(1, "mеmory", title="fine"), _post(2, None, title=None), _post(3, "", title="Ｇｒｏｋ"), _post(4, "好的。👩‍💻", title="“é”")]
    posts = spark.createDataFrame(rows, POSTS)
    assert {(r.id, r.field) for r in confusables.affected_fields(posts, "id", ["title", "content"]).collect()} == {(1, "content"), (3, "title")}
    forms = confusables.consistent_texts(confusables.fields_of(posts, "id", ["title", "content"]))
    assert forms.count() == 8 and forms.filter("form is null and not affected").count() == 2
    twice = spark.createDataFrame([(1, "content", "memory"), (2, "content", "mеmory"), (3, "content", "other")], "id bigint, field string, text string")
    assert [(r.n_texts, r.n_forms, r.first_id) for r in confusables.look_alike_groups(twice).collect()] == [(2, 2, 1)]


def test_residue_tables(spark, monkeypatch):
    banner = "Please enable JavaScript to view this page."
    rows = [(k, f"{banner}\nA whole text number {k} about trains.", "www.host.example") for k in range(12)] + [(20, "{{title}}", None), (21, None, "a"), (22, " \n", "a"), (23, banner, "b.example"), (24, "Fine.", "b.example"), (24, "Fine.", "b.example")]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id bigint, text string, domain string, lines int, host int")
    assert {(r.doc_id, r.kind) for r in residue.residues(docs).collect()} == {(20, "placeholder"), (23, "script")}
    assert residue.clean_documents(docs).count() == len(rows) - 2
    # A host of nothing but error pages, and the way with more recurrent lines than all tasks are given.
    pages = spark.createDataFrame([(100 + k, "404 Not Found", "dead.example") for k in range(50)], "doc_id bigint, text string, domain string")
    both = docs.select("doc_id", "text", "domain").unionByName(pages)
    want = {(20, "placeholder"), (23, "script")} | {(100 + k, "error") for k in range(50)}
    assert {(r.doc_id, r.kind) for r in residue.residues(both).collect()} == want
    monkeypatch.setattr(residue, "FEW_LINES", 0)
    assert {(r.doc_id, r.kind) for r in residue.residues(both).collect()} == want
    assert residue.residues(docs.filter("false")).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    words = {"a": "train station rail".split(), "b": "apple pear plum".split(), "c": "sea wave ship".split()}
    rows = [(k, s, " ".join(rng.choices(words[s], k=rng.randrange(20, 60)))) for k, s in enumerate(rng.choices("abc", [6, 3, 1], k=400))]
    rows += [(900, None, "apple pear plum " * 10), (901, "a", None), (902, "a", ""), (903, "z", "other"), (904, " A ", "rail rail station")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, text string, copies int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(docs, targets).collect()
    limit = {"a": 1, "b": 2, "c": 3, None: 3}
    assert all(1 <= r.copies <= limit[r.source] for r in mix) and {901, 902, 903}.isdisjoint(r.doc_id for r in mix)
    total = sum(r.tokens * r.copies for r in mix)
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(r.tokens * r.copies for r in mix if r.source == source) / total - share) < 0.03
    more = targets.unionByName(spark.createDataFrame([("none", 0.5, 2)], targets.schema))
    assert sum(r.tokens * r.copies for r in mixing.mixed(docs, more).collect()) == pytest.approx(total, rel=0.02)
    report = {r.source: r for r in mixing.reached_shares(docs, more).collect()}
    assert report["none"].reached_share == 0 and all(abs(report[s].reached_share - share) < 0.02 for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert mixing.mixed(docs.filter("false"), targets).count() == 0
    assert mixing.mixed(docs, targets.filter("false")).count() == 0


def test_short_text_in_two_languages(spark):
    posts, labels = table(spark, SMALL, "posts"), table(spark, SMALL, "post_langs")
    short = spark.createDataFrame([(-1, "這個模型的回答比以前慢了很多，大家覺得呢？\nHas anyone else noticed the slow answers?"), (-2, "Has anyone else noticed\nthe slow answers?")], "id bigint, content string")
    assert short.filter("length(content) >= 80").count() == 0
    got = {(r.post_id, r.lang) for r in langid.relabelled(posts.select("id", "content").unionByName(short), labels).filter("post_id < 0").collect()}
    assert got == {(-1, "zh-Hant"), (-1, "en")}


def test_texts_of_signs_alone_are_texts(spark):
    from sparkrill.llm.lsh_forest import same_text_pairs

    signs = "".join(chr(0x1F600 + k * 7 % 60) for k in range(90))
    other = "".join(chr(0x1F300 + k * 11 % 120) for k in range(90))
    rows = [(1, signs), (2, signs), (3, signs[:40] + " " + signs[40:]), (4, other), (5, signs[:79]), (6, " " * 90), (7, " " * 90), (8, None), (9, "words of a text " * 9)]
    got = {tuple(r) for r in same_text_pairs(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
