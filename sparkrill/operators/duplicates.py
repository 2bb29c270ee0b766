"""Posts of one story: same canonical address, or titles with nearly the same words; which of them stays; the flags that say so."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sparkrill.functions.text import canonical_url, title_tokens
from sparkrill.operators.components import components
from sparkrill.storage import drop_table, written, written_in_rounds

SIMILARITY, MIN_TOKENS, MAX_HAMMING = 0.8, 4, 3
DELETING = 32  # tokens of two sets together, up to which they may meet by what is left without two
# Sets that a round of classes or stars takes, up to the most rounds: each shuffles its share, and all of them read all sets.
ROUND, ROUNDS = 100_000, 6
# Which source stays before which.
SOURCE_RANK = {"lobsters": 0, "hackernews": 1, "devto": 2, "reddit": 3, "threads": 4}


def url_edges(posts: DataFrame) -> DataFrame:
    """(a, b): each post with the smallest id of its canonical address; a star, so a popular address makes no pairs. A written table."""
    named = written(posts.select("id", canonical_url(F.col("url")).alias("key")).filter("key is not null"), "urls")
    # Only addresses of several posts take part: few rows, which are broadcast where they are small, and no address is sorted whole.
    shared = named.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    edges = written(named.join(shared, "key").filter("id <> a").select("a", F.col("id").alias("b")), "url-edges")
    drop_table(named)
    return edges


def title_sets(posts: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, tokens) of posts with enough title words."""
    return posts.select("id", F.array_sort(title_tokens(F.col("title"))).alias("tokens")).filter(F.size("tokens") >= min_tokens)


def set_classes(sets: DataFrame) -> DataFrame:
    """(id, rep, tokens) of sets (id, tokens); rep is the smallest id with the same set."""
    return sets.hint("merge").join(sets.groupBy("tokens").agg(F.min("id").alias("rep")), "tokens")


def title_classes(posts: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, rep, tokens) of posts with enough title words; rep is the smallest id with the same set of words."""
    return set_classes(title_sets(posts, min_tokens))


def _rounds(sets: DataFrame) -> int:
    return min(ROUNDS, sets.count() // ROUND + 1)


def _first_by_parts(share: float, eps: float = 1e-9) -> int:
    """The smallest number of tokens of two sets together for which they meet by parts."""
    return next(s for s in itertools.count(1) if s > DELETING or int(s * share + eps) > 2)


def _set_keys(sets: DataFrame, similarity: float, small: bool = True, large: bool = True, check: bool = False) -> DataFrame:
    """(key, id, nr, bits): the keys that similar sets meet by; nr is twice the number of tokens, and one more where a key only looks for whole ones.
    small: those by what is left, with a second hash of it in bits if check; large: those by parts."""
    share, eps = (1 - similarity) / (1 + similarity), 1e-9
    first = _first_by_parts(share, eps)
    n, zero = F.size("h"), F.lit(0).cast("bigint")

    def xor(values: Column) -> Column:
        return F.aggregate(values, zero, lambda x, y: x.bitwiseXOR(y))

    def most(total: Column) -> Column:
        """Tokens that may be in one set only, where the two have `total`."""
        return F.floor(total * share + eps).cast("int")

    def deleting(total: Column, least: int) -> Column:
        return (total < first) & (most(total) >= least)

    def rows(keys: Column, role: int, bits: Column = zero) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), (n * 2 + role).alias("nr"), bits.alias("bits")))

    def either(condition: Column, array: Column) -> Column:
        return F.when(condition, array).otherwise(F.array().cast("array<struct<key:bigint,nr:int,bits:bigint>>"))

    def left(whole: Column, h: Column) -> list[Column]:
        """What is left of a set: all; without each token; without each two; without each token, for sets that lack one each."""
        one = F.transform(h, lambda x: whole.bitwiseXOR(x))
        two = F.flatten(F.transform(h, lambda x, i: F.transform(F.slice(h, i + 2, n), lambda y: whole.bitwiseXOR(x).bitwiseXOR(y))))
        return [F.array(whole), one, two, F.transform(one, lambda k: F.xxhash64(k))]

    def checked(keys: Column, checks: Column, role: int) -> Column:
        return F.zip_with(keys, checks, lambda k, c: F.struct(k.alias("key"), (n * 2 + role).alias("nr"), c.alias("bits")))

    h = F.col("h")
    when = [2 * n < first, deleting(2 * n - 1, 1), deleting(2 * n - 2, 2), deleting(2 * n, 2)]
    keys, roles = left(F.col("whole"), h), [0, 1, 1, 0]
    few = [either(w, checked(k, c, role)) for w, k, c, role in zip(when, keys, left(F.col("whole2"), F.col("h2")), roles)] if check else [either(w, rows(k, role)) for w, k, role in zip(when, keys, roles)]
    # Numbers of parts, each with the one before it: those that some size of the other set asks for.
    steps = [1, *[x << k for k in range(18) for x in (2, 3)]]
    low, high = F.greatest(n + F.ceil(n * similarity - eps).cast("int"), F.lit(first)), n + F.floor(n / similarity + eps).cast("int")
    need = [F.floor(most(total) / 2).cast("int") + 1 for total in (low, high)]
    counts = F.filter(F.array(*[F.struct(F.lit(x).alias("before"), F.lit(y).alias("parts")) for x, y in zip([0, *steps], steps)]), lambda s: (s["parts"] >= need[0]) & (s["before"] < need[1]))
    split = F.flatten(F.transform(counts, lambda s: F.transform(F.sequence(F.lit(0), s["parts"] - 1), lambda q: F.struct(s["parts"].alias("parts"), q.alias("q")))))
    inside = F.transform(split, lambda s: F.struct(s["parts"].alias("parts"), s["q"].alias("q"), F.filter(h, lambda x: F.pmod(F.shiftrightunsigned(x, 32), s["parts"]) == s["q"]).alias("h")))
    bits = F.aggregate(h, zero, lambda x, y: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), y.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))))

    def named(key: Column, s: Column) -> Column:
        return F.xxhash64(key, s["parts"], s["q"])

    parts = F.concat(rows(F.transform(inside, lambda s: named(xor(s["h"]), s)), 0, bits), rows(F.flatten(F.transform(inside, lambda s: F.transform(s["h"], lambda x: named(xor(s["h"]).bitwiseXOR(x), s)))), 1, bits))
    hashed = sets.filter(F.size("tokens") > 0).select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"), F.transform("tokens", lambda t: F.xxhash64(F.lit(2), t)).alias("h2"))
    hashed = hashed.select("id", "h", "h2", xor(F.col("h")).alias("whole"), xor(F.col("h2")).alias("whole2"))
    return hashed.select("id", F.explode(F.concat(*few * small, *[either(high >= first, parts)] * large)).alias("k")).select("k.key", "id", "k.nr", "k.bits")


def similar_sets(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity), a < b, of the sets (id, tokens) with at least that Jaccard similarity. Exact.

    Of `total` tokens of two similar sets at most total * (1 - similarity) / (1 + similarity) are in one of them only. Where these are
    at most two and the sets small, the sets meet by what is left without one or two tokens: only similar ones do. Where they are more, the
    tokens are dealt by hash to half as many parts and one more, of which one is equal but for a token at most, and the sets meet by
    the parts and by the parts without one token. Bits of all tokens, of which as many differ at most, then keep nearly all others out before
    any pair is written. Keys grow with the tokens, however frequent a token is.
    """
    return _compared(_meeting(_set_keys(sets, similarity), similarity), sets).filter(F.col("similarity") >= similarity)


def _meeting(keys: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of the sets that meet by keys and may be similar by their bits."""
    left = keys.filter("nr % 2 = 0").select("key", F.col("id").alias("x"), F.col("nr").alias("nx"), F.col("bits").alias("bx"))
    right = keys.select("key", F.col("id").alias("y"), F.col("nr").alias("ny"), F.col("bits").alias("by"))
    total = F.shiftright("nx", 1) + F.shiftright("ny", 1)
    near = (F.col("x") != F.col("y")) & ((F.col("ny") % 2 == 1) | (F.col("x") < F.col("y"))) & (hamming(F.col("bx"), F.col("by")) <= total * ((1 - similarity) / (1 + similarity)) + 1e-9)
    # Keys are taken to be as few as the sets they come from: without the hint, up to some size of these all keys go through the driver.
    return left.hint("merge").join(right, "key").filter(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b and more) of sets with their similarity."""
    whole, more = sets.select("id", "tokens"), [c for c in pairs.columns if c not in ("a", "b")]
    # Sets are compressed in files, many times where they have few words: their size there doesn't tell what they are in the driver.
    joined = pairs.join(whole.select(F.col("id").alias("a"), F.col("tokens").alias("x")).hint("merge"), "a").join(whole.select(F.col("id").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return joined.select("a", "b", *more, (shared / (F.size("x") + F.size("y") - shared)).alias("similarity"))


def linked_sets(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: similar sets, enough of them that the sets are connected as by all of similar_sets; a written table.

    Small sets that meet by what is left without one or two tokens are all similar to the smallest of those that have just that left: a star
    around it says as much as all their pairs, so that links grow with the keys of the sets and not with the square of those of one build.
    What is left is known by 128 bits of hashes of its tokens, so that stars are not compared by their tokens again; sets that meet by parts are.
    """
    share, eps = (1 - similarity) / (1 + similarity), 1e-9
    few, role, rounds = _set_keys(sets, similarity, large=False, check=True), F.col("nr") % 2, _rounds(sets)
    first = F.min(F.when(role == 0, F.col("id"))).over(W.partitionBy("key", "bits").orderBy(role, "id").rowsBetween(W.unboundedPreceding, W.currentRow))

    def stars(keys: DataFrame) -> DataFrame:
        return keys.select("id", first.alias("first")).filter("id <> first").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()

    # Sets meet under one key, so that keys can go round by round.
    linked = [written_in_rounds((stars(few.filter(F.pmod("key", F.lit(rounds)) == k)) for k in range(rounds)), "title-stars")]
    # Each written by itself: neither has to be kept with what the other shuffles.
    many = sets.filter(F.size("tokens") + F.floor(F.size("tokens") / similarity + eps) >= _first_by_parts(share, eps))
    met = written(_meeting(_set_keys(many, similarity, small=False), similarity), "title-met")
    linked.append(written(_compared(met, many).filter(F.col("similarity") >= similarity).select("a", "b"), "title-links"))
    drop_table(met)
    return linked[0].unionByName(linked[1])


def title_edges(posts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): near titles, as many as connect all of them; written tables. Equal sets of words are a star around their smallest id."""
    sets = written(title_sets(posts), "title-sets")
    rounds = _rounds(sets)
    of = F.pmod(F.xxhash64("tokens"), F.lit(rounds))
    classes = written_in_rounds((set_classes(sets.filter(of == k)) for k in range(rounds)), "title-classes")
    drop_table(sets)
    near = linked_sets(classes.filter("id = rep").select("id", "tokens"), similarity)
    equal = written(classes.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")), "title-equal")
    drop_table(classes)
    return near.unionByName(equal)


@F.pandas_udf(LongType())
def simhash64(tokens: pd.Series) -> pd.Series:
    """64-bit SimHash of a set of words by BLAKE2b, as a signed number; 0 for an empty set."""
    import hashlib

    import numpy as np

    def one(words: list[str] | None) -> int:
        if words is None or not len(words):
            return 0
        hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in words], np.uint64)
        votes = ((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0) * 2 - len(hashes)
        return int((np.uint64(1) << np.flatnonzero(votes > 0).astype(np.uint64)).sum(dtype=np.uint64).view(np.int64))

    return tokens.map(one)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_edges(posts: DataFrame, max_hamming: int = MAX_HAMMING, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): titles with a SimHash within max_hamming bits and similar words. Four bands of 16 bits lose none within three bits."""
    classes = written(title_classes(posts), "simhash-classes")
    reps = classes.filter("id = rep").select("id", "tokens", simhash64("tokens").alias("h"))
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("h", 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("value")) for k in range(4)])
    keyed = reps.select("id", "h", F.explode(bands).alias("key")).select("id", "h", "key.band", "key.value")
    left, right = keyed.select(F.col("id").alias("a"), F.col("h").alias("ha"), "band", "value"), keyed.select(F.col("id").alias("b"), F.col("h").alias("hb"), "band", "value")
    # Hashes meet in their bands; words are compared for the few pairs that are left.
    pairs = left.join(right, ["band", "value"]).filter("a < b").filter(hamming(F.col("ha"), F.col("hb")) <= max_hamming).select("a", "b").distinct()
    words = classes.filter("id = rep").select("id", "tokens")
    shared = F.size(F.array_intersect("x", "y"))
    near = pairs.join(words.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(words.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").filter(shared >= similarity * (F.size("x") + F.size("y") - shared))
    return near.select("a", "b").unionByName(classes.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))


def clusters(posts: DataFrame) -> DataFrame:
    """(id, component) of the posts in a cluster of at least two."""
    edges = title_edges(posts).unionByName(url_edges(posts))
    found = components(edges)
    drop_table(edges)
    return found


def canonicals(posts: DataFrame, clustered: DataFrame) -> DataFrame:
    """(id, component, canonical_id): the post that stays is the earliest, then the most engaging, then by source, then the smallest id."""
    rank = F.coalesce(F.element_at(F.create_map(*[x for s, r in SOURCE_RANK.items() for x in (F.lit(s), F.lit(r))]), F.col("source")), F.lit(99))
    order = F.struct(F.col("posted_at").isNull().cast("int"), F.coalesce(F.unix_micros("posted_at"), F.lit(0)), -(F.coalesce("score", F.lit(0)) + F.coalesce("num_comments", F.lit(0))), rank, F.col("id"))
    rows = clustered.join(posts.select("id", order.alias("order")), "id")
    best = rows.groupBy("component").agg(F.min_by("id", "order").alias("canonical_id"))
    return clustered.join(best, "component").select("id", "component", "canonical_id")


def reconciled_flags(posts: DataFrame, picked: DataFrame) -> DataFrame:
    """(id, quality_flags): duplicate flags as the clusters say, all others as they were. Applied twice it changes nothing more."""
    kept = F.filter(F.coalesce("quality_flags", F.array().cast("array<string>")), lambda f: (f != "DUPLICATE") & ~f.startswith("CANONICAL:"))
    double = F.col("canonical_id").isNotNull() & (F.col("canonical_id") != F.col("id"))
    marks = F.when(double, F.array(F.lit("DUPLICATE"), F.concat(F.lit("CANONICAL:"), F.col("canonical_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    return posts.select("id", "quality_flags").join(picked.select("id", "canonical_id"), "id", "left").select("id", F.array_sort(F.array_distinct(F.concat(kept, marks))).alias("quality_flags"))
