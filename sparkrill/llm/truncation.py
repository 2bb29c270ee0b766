"""Texts that lost their end.

Per source and column, histograms of the lengths in characters and in bytes over all texts show the limits as spikes; a
text of a spike's length without an end is cut. Elsewhere a text is cut if it ends in a cut mark, inside a code block,
in a broken character, or in the middle of a word or sentence. The last is read from the corpus itself: how often the
last tokens, wherever they stand in all texts, end a sentence and how often they go on.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrill.llm.accounts import source_name
from sparkrill.llm.prefilter import marked, slots_for
from sparkrill.llm.shingles import _tables, mixed
from sparkrill.storage import written

SPIKE_COUNT = 5  # texts a spike has at least
SPIKE_FACTOR = 8.0  # times the mean count of the lengths around it
SPIKE_REACH = 20
CONTEXTS = (6, 4, 3, 2, 1)  # tokens of a context, the longest that is known decides
MASKED = (3, 2)  # tokens before an unknown last token
WORD = len(CONTEXTS) + len(MASKED)  # the kind that asks whether the last word is whole
WHOLE_SHARE = 1 / 11  # of the words that begin with it: below, a word is taken for the beginning of another
SUPPORT = 3
SURE = 20  # times a context was seen, from which it outweighs the look of the last word
END_SHARE = 0.1
RECURRING = 5  # texts in which a closing phrase stands at least, after 3 different words
TAIL = 400
_STEP = 2000
_MUL = np.uint64(0x9E3779B97F4A7C15)

# Marks that a crawler or a page puts where it cut.
CUT_MARK = re.compile(
    r"(?:(?:…|⋯|\.{3})\s*[(（\[]?\s*(?:see more|read more|show more|more|continued|continue reading|查看更多|顯示更多|显示更多|展開|展开|更多|續|续|続く|続きを読む|もっと見る|leer más|ver más|ver mais|leia mais|lire la suite|voir plus|mehr anzeigen|mehr)\s*[)）\]]?"
    r"|\[\s*\+\s*\d+\s*char(?:acter)?s?\s*\]|[\[(]\s*(?:truncated|cut off|snip|gekürzt|tronqué|truncado|cortado)\s*[\])])\s*$",
    re.I,
)
_ENDED = re.compile(r"[.!?。！？…‥｡][\"'”’»」』）)\]】*_~`]*\s*$")
_TAG_OR_LINK = re.compile(r"(?:^|\s)(?:[#＃@][^\s#@]+|https?://\S+|www\.\S+)\s*$")
_SMILEY = re.compile(r"(?:^|\s)[:;=8xX]['’]?-?[)(DPpOo3/|\]\[]\s*$|[\^>][_.][\^<]\s*$")
_NUMBER_COLON = re.compile(r"\d:\s*$")
_IRONY = re.compile(r"(?:^|\s)/s\s*$")
_ENTITY = re.compile(r"&(?:amp|lt|gt|quot|apos|nbsp|#\d+|#x[0-9a-fA-F]+);")
_BROKEN_ENTITY = re.compile(r"&(?:#\d*|#x[0-9a-fA-F]*|am?p?|ap?o?s?|lt?|gt?|qu?o?t?|nb?s?p?)?$")
_TERMINAL = frozenset(".!?。！？…‥｡")
FINISHED, OPEN, CUT, LINKED = 0, 1, 2, 3


def ending(text: str) -> int:
    """How a text ends, as far as the text alone tells. LINKED: in a tag or link, which only a limit can have cut."""
    if text.rstrip()[-1:] == "�" or CUT_MARK.search(text[-80:]) or text.count("```") % 2 or _BROKEN_ENTITY.search(text[-8:]):
        return CUT
    tail = text[-200:].rstrip()
    if "&" in tail:
        tail = _ENTITY.sub(lambda found: html.unescape(found[0]), tail).rstrip()
    if not tail or tail.endswith("```") or _ENDED.search(tail[-12:]):
        return FINISHED
    last = tail[-1]
    if unicodedata.category(last) in ("So", "Sk", "Mn", "Me") or last in "‍️" or _SMILEY.search(tail) or _NUMBER_COLON.search(tail) or _IRONY.search(tail) or tail[-1:] in ">`":
        return FINISHED
    return LINKED if _TAG_OR_LINK.search(tail) else OPEN


def _sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes; whether a sentence ends after each (the last token of a text without an end: False); whether the token
    is the last of its text; the token at which its sentence begins; and whether dots follow that may stand for an end or for what was cut."""
    fold, single = _tables()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    folded, alone = np.maximum(fold[codes], 0), single[codes]
    inside = folded > 0
    run = inside & ~alone
    begins = run.copy()
    begins[1:] &= ~run[:-1]
    starts = np.flatnonzero(begins | (inside & alone))
    none = np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), none.astype(bool), none.astype(bool), none, none.astype(bool)
    stops = np.append(starts[1:], len(codes))
    place = np.arange(starts[0], len(folded)) - np.repeat(starts, stops - starts)
    digit = (codes >= 48) & (codes <= 57)
    # All numbers are alike: runs of digits hash as one zero.
    number = np.maximum.reduceat((inside & ~digit).astype(np.int8), starts) == 0
    powers = np.cumprod(np.full(min(int(place.max()) + 1, 4096), _MUL, np.uint64))
    terms = np.where(inside[starts[0] :], mixed(folded[starts[0] :].astype(np.uint64)) * powers[place % len(powers)], np.uint64(0))
    hashes = np.where(number, np.uint64(0x1234567), mixed(np.add.reduceat(terms, starts - starts[0])))
    # The characters between a token and the next.
    marks = np.isin(codes, [ord(c) for c in _TERMINAL])
    gaps = stops - starts - np.add.reduceat(inside[starts[0] :].astype(np.int64), starts - starts[0])
    before = np.add.reduceat(marks[starts[0] :].astype(np.int64), starts - starts[0])
    wide = np.add.reduceat((marks & (codes > 127)).astype(np.int64)[starts[0] :], starts - starts[0]) > 0
    text_of = np.searchsorted(np.cumsum(lengths), starts, side="right")
    last = np.append(text_of[1:] != text_of[:-1], True)
    ends = (before > 0) & (wide | (gaps >= 2) | last)
    opens = np.append(True, (ends | last)[:-1])
    begin = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    dots = np.add.reduceat((codes == 46).astype(np.int64)[starts[0] :], starts - starts[0]) >= 3
    dots |= np.add.reduceat(np.isin(codes, [0x2026, 0x2025, 0x22EF]).astype(np.int64)[starts[0] :], starts - starts[0]) > 0
    return hashes, ends & ~dots, last, begin, dots


def _beginnings(texts: list[str], filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All beginnings of words (runs of letters) of the texts that the filter asks for, as hashes, and whether each is a whole word. The
    open last word of a text is left out, as it may be no whole one."""
    fold, single = _tables()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.maximum(fold[codes], 0)
    run = (folded > 0) & ~single[codes]
    begins = run.copy()
    begins[1:] &= ~run[:-1]
    at = np.flatnonzero(run)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    starts = np.flatnonzero(begins)
    first = starts[np.cumsum(begins)[at] - 1]
    place = at - first
    powers = np.cumprod(np.full(min(int(place.max()) + 1, 4096), _MUL, np.uint64))
    sums = np.cumsum(mixed(folded[at].astype(np.uint64)) * powers[place % len(powers)], dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], sums])[np.searchsorted(at, first)]
    hashes = mixed(mixed(sums - before) + np.uint64(WORD))
    ends = np.append(at[1:] != at[:-1] + 1, True)
    stops = np.cumsum(lengths) - 1
    # The last word of a text that goes up to its end.
    open_ = ends & np.isin(at + 1, stops)
    wanted = filled[_slot(hashes, len(filled))] & ~open_
    return hashes[wanted], ends[wanted]


def _contexts(hashes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each kind of context: its number, the tokens that have one, and the context's hash there."""
    at = np.arange(len(hashes))
    for kind, (size, skip) in enumerate([(n, 0) for n in CONTEXTS] + [(n, 1) for n in MASKED]):
        has = np.flatnonzero(at - begin >= size + skip - 1)
        total = np.full(len(has), np.uint64(kind + 1))
        for k in range(size):
            total = total * _MUL + hashes[has - skip - k]
        yield kind, has, mixed(total)


def _endings(texts: DataFrame) -> DataFrame:
    """(tbl, id, round, source, chars, bytes, how, named, contexts, phrase, before) of each text that isn't null or blank. Narrow."""
    schema = "tbl string, id bigint, round int, source string, chars int, bytes int, how int, named boolean, contexts array<bigint>, phrase bigint, phrase_size int, before bigint"
    kinds = len(CONTEXTS) + len(MASKED)
    _, single = _tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(4).to_pylist()
            how = [ending(t) for t in values]
            at = [i for i, h in enumerate(how) if h in (OPEN, LINKED)]
            contexts: list[list[int | None] | None] = [None] * len(values)
            phrase: list[int | None] = [None] * len(values)
            sizes: list[int | None] = [None] * len(values)
            before: list[int | None] = [None] * len(values)
            named = [False] * len(values)
            if at:
                tails = [values[i][-TAIL:] for i in at]
                hashes, _, last, begin, _ = _sentences(tails)
                where = np.flatnonzero(last)
                filled = [i for i, t in zip(at, tails) if _has_token(t)]
                table = np.zeros((len(where), kinds), np.int64)
                known = np.zeros((len(where), kinds), bool)
                for kind, has, value in _contexts(hashes, begin):
                    hit = np.isin(where, has)
                    table[hit, kind] = value[np.searchsorted(has, where[hit])].view(np.int64)
                    known[hit, kind] = True
                for row, (i, w) in enumerate(zip(filled, where)):
                    contexts[i] = [int(v) if k else None for v, k in zip(table[row], known[row])]
                    word = _LAST_WORD.search(values[i][-80:])
                    letters = bool(word) and word.end() == len(values[i][-80:].rstrip()) and not single[ord(word[0][-1])] and not word[0][-1].isdigit()
                    contexts[i].append(int(mixed(hashes[w : w + 1] + np.uint64(WORD))[0].view(np.int64)) if letters else None)
                    span = hashes[begin[w] : w + 1]
                    if len(span) <= 6:
                        phrase[i] = int(mixed(np.array([np.bitwise_xor.reduce(mixed(span + np.arange(len(span), dtype=np.uint64)))]))[0].view(np.int64))
                        sizes[i] = len(span)
                        # Null: the phrase is the whole text.
                        inner = begin[w] > 0 and not last[begin[w] - 1]
                        before[i] = int(hashes[begin[w] - 1].view(np.int64)) if inner else None
                    named[i] = bool(word) and word[0][0].isupper()
            columns = [batch.column(k) for k in range(4)]
            lengths = [pa.array([len(t) for t in values], pa.int32()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in values], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + lengths + [pa.array(how, pa.int32()), pa.array(named), pa.array(contexts, pa.list_(pa.int64())), pa.array(phrase, pa.int64()), pa.array(sizes, pa.int32()), pa.array(before, pa.int64())], [c.split()[0] for c in schema.split(", ")])

    return texts.mapInArrow(run, schema)


_LAST_WORD = re.compile(r"[^\W_]+(?=[\W_]*$)")


def _has_token(text: str) -> bool:
    fold, _ = _tables()
    return bool((fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] > 0).any())


def _slot(contexts: np.ndarray, size: int) -> np.ndarray:
    return (contexts.view(np.uint64) >> np.uint64(20)) & np.uint64(size - 1)


def _counts(texts: DataFrame, asked: bytes) -> DataFrame:
    """(context, ends, goes_on) over all texts for the contexts in the filter; others that share a slot do no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.unpackbits(np.frombuffer(asked, np.uint8)).astype(bool)
        for batch in batches:
            values = batch.column(0).to_pylist()
            for first in range(0, len(values), _STEP):
                hashes, ends, last, begin, dots = _sentences(values[first : first + _STEP])
                found, ended = [], []
                for _, has, value in _contexts(hashes, begin):
                    ok = filled[_slot(value, len(filled))] & ~dots[has] & (ends[has] | ~last[has])
                    found.append(value[ok])
                    ended.append(ends[has][ok])
                words, whole = _beginnings(values[first : first + _STEP], filled)
                found.append(words)
                ended.append(whole)
                if found and len(all_found := np.concatenate(found)):
                    context, back = np.unique(all_found, return_inverse=True)
                    n = np.bincount(back)
                    n_end = np.bincount(back, weights=np.concatenate(ended)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(n_end), pa.array(n - n_end)], ["context", "ends", "goes_on"])

    return texts.select("text").mapInArrow(run, "context bigint, ends bigint, goes_on bigint").groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))


def spikes(endings: DataFrame) -> DataFrame:
    """(tbl, source, unit, length): the lengths at which a source and column cut, from histograms in characters and bytes.

    A spike has at least SPIKE_COUNT texts and SPIKE_FACTOR times the mean count of the SPIKE_REACH lengths on either
    side, and texts without an end are the most of it.
    """
    # A short phrase that is the whole text says nothing about limits.
    longer = endings.filter("phrase is null or before is not null")
    both = longer.select("tbl", "source", F.expr("explode(array(struct('chars' AS unit, chars AS length), struct('bytes' AS unit, bytes AS length))) AS u"), F.when(F.col("how") == OPEN, 1).otherwise(0).alias("open"))
    histogram = both.groupBy("tbl", "source", "u.unit", "u.length").agg(F.count("*").alias("n"), F.sum("open").alias("open"))
    around = W.partitionBy("tbl", "source", "unit").orderBy("length").rangeBetween(-SPIKE_REACH, SPIKE_REACH)
    mean = (F.sum("n").over(around) - F.col("n")) / (2 * SPIKE_REACH)
    return histogram.withColumn("mean", mean).filter((F.col("n") >= SPIKE_COUNT) & (F.col("n") >= SPIKE_FACTOR * F.col("mean")) & (2 * F.col("open") > F.col("n"))).select("tbl", "source", "unit", "length")


def cut_texts(texts: DataFrame) -> DataFrame:
    """(tbl, id, round, source, cut) of each text of texts (tbl, id, round, source, text) that isn't null or blank.

    Null sources are a source of their own. Repeated rows give repeated rows. An empty table gives an empty one.
    """
    filled = texts.filter(F.col("text").rlike(r"\S"))
    ends = written(_endings(filled.select("tbl", F.col("id").cast("bigint").alias("id"), F.col("round").cast("int").alias("round"), F.coalesce("source", F.lit("")).alias("source"), "text")), "cut-endings")
    unsure = ends.filter(F.col("how") == OPEN)
    asked_rows = unsure.select("tbl", "id", "round", F.posexplode("contexts").alias("kind", "context")).filter("context is not null")
    # The filter's size follows the contexts asked for, up to 8 megabytes of bits.
    asked_rows = written(asked_rows, "cut-asked")
    size = slots_for(asked_rows.agg(F.approx_count_distinct("context")).first()[0])
    slots = asked_rows.select(F.expr(f"cast(shiftrightunsigned(context, 20) & {size - 1} as int) AS slot"))
    counts = _counts(filled, marked(slots.repartition(8), size))
    seen = asked_rows.join(counts, "context").filter(F.col("ends") + F.col("goes_on") >= SUPPORT)
    plain, masked = F.col("kind") < len(CONTEXTS), F.col("kind").between(len(CONTEXTS), WORD - 1)
    share = F.col("ends") / (F.col("ends") + F.col("goes_on"))
    best = seen.groupBy("tbl", "id", "round").agg(F.min(F.when(plain, F.col("kind"))).alias("kind"), F.min_by(F.when(plain, share), F.when(plain, F.col("kind"))).alias("share"), F.min_by(F.when(plain, F.col("ends") + F.col("goes_on")), F.when(plain, F.col("kind"))).alias("seen"), F.min_by(F.when(masked, share), F.when(masked, F.col("kind"))).alias("masked"), F.max(F.when(F.col("kind") == WORD, share)).alias("whole"))
    phrases = unsure.filter("phrase is not null and before is not null").groupBy("phrase", "before").agg(F.count("*").alias("n")).groupBy("phrase").agg(F.sum("n").alias("n"), F.count("*").alias("different")).filter((F.col("n") >= RECURRING) & (F.col("different") >= 3)).select("phrase", F.lit(True).alias("closing"), F.col("n").alias("closings"))
    limits = spikes(ends)
    at_chars = limits.filter("unit = 'chars'").select("tbl", "source", F.col("length").alias("chars"), F.lit(True).alias("full_chars"))
    at_bytes = limits.filter("unit = 'bytes'").select("tbl", "source", F.col("length").alias("bytes"), F.lit(True).alias("full_bytes"))
    rows = ends.join(at_chars, ["tbl", "source", "chars"], "left").join(at_bytes, ["tbl", "source", "bytes"], "left")
    rows = rows.join(best.dropDuplicates(["tbl", "id", "round"]), ["tbl", "id", "round"], "left").join(phrases, "phrase", "left")
    full = F.coalesce("full_chars", "full_bytes", F.lit(False))
    size_of = F.element_at(F.array(*[F.lit(n) for n in CONTEXTS]), F.col("kind") + 1)
    widest = F.element_at(F.array(*[F.lit(max(n for n in CONTEXTS if n <= k)) for k in range(1, 7)]), F.col("phrase_size"))
    # A phrase that closes many texts and isn't itself known to go on much more often: a greeting has no full stop to count as an end.
    closed = (F.col("share") * F.col("seen") + F.col("closings")) / (F.col("seen") + F.col("closings"))
    closing = F.coalesce("closing", F.lit(False)) & (F.col("kind").isNull() | (size_of < widest) | (F.col("masked").isNull() & (closed >= END_SHARE)))
    alone = F.col("phrase").isNotNull() & F.col("before").isNull()
    # A beginning of a word that is hardly ever whole, unless the words before it are well known to end with it, or with some name where it is one.
    known = F.coalesce(size_of > 1, F.lit(False)) & (F.col("share") >= END_SHARE)
    fits = F.coalesce(F.col("masked") >= 0.5, F.lit(False)) & (F.col("named") | (known & (F.col("share") >= 0.5)))
    begun = (F.col("whole") < WHOLE_SHARE) & ~(known & (F.col("seen") >= SURE)) & ~fits
    middle = (
        F.when(closing, F.lit(False))
        .when(F.coalesce(begun, F.lit(False)), F.lit(True))
        # A name stands where other names do: the words before it tell more than the name alone.
        .when(F.col("masked").isNotNull() & F.col("named") & (F.col("kind").isNull() | (size_of == 1)), F.col("masked") < END_SHARE)
        .when(F.col("share").isNotNull(), F.col("share") < END_SHARE)
        .otherwise(F.lit(True))
    )
    cut = F.when(F.col("how") == CUT, True).when(F.col("how") == OPEN, ~alone & (full | (F.col("contexts").isNotNull() & middle))).otherwise(F.lit(False))
    return rows.select("tbl", "id", "round", "source", cut.alias("cut"))


def truncated(posts: DataFrame, gold: DataFrame) -> DataFrame:
    """(record_table, post_id, round) of the contents and snapshots that lack their end, each once.

    Besides its own ending, a snapshot is cut if it breaks off inside its post's "title. content", or if it ends with
    a content that is cut. Snapshots of unknown posts are judged by their ending alone.
    """
    one = posts.select(F.lit("posts").alias("tbl"), F.col("id").cast("bigint").alias("id"), F.lit(0).alias("round"), source_name(F.col("source")).alias("source"), F.col("content").alias("text"))
    two = gold.select(F.lit("gold_labels").alias("tbl"), F.col("post_id").cast("bigint").alias("id"), F.col("round").cast("int").alias("round"), source_name(F.col("source")).alias("source"), "text")
    judged = written(cut_texts(one.unionByName(two)), "cut-judged")
    own = judged.filter("cut").select("tbl", "id", "round")
    snapshots = two.select("id", "round", "text").filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    cut_posts = judged.filter("cut and tbl = 'posts'").select("id", "cut").distinct()
    whole = posts.select(F.col("id").cast("bigint").alias("id"), F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("content", F.lit(""))).alias("whole"), F.col("content"))
    beside = snapshots.join(whole, "id").join(cut_posts, "id", "left")
    broken = F.col("whole").startswith(F.col("text")) & (F.length(F.rtrim("whole")) > F.length(F.rtrim("text")))
    inherited = F.coalesce("cut", F.lit(False)) & (F.length("content") > 0) & F.col("text").endswith(F.col("content"))
    more = beside.filter(broken | inherited).select(F.lit("gold_labels").alias("tbl"), "id", "round")
    return own.unionByName(more).distinct().select(F.col("tbl").alias("record_table"), F.col("id").alias("post_id"), "round")


def truncation_report(posts: DataFrame, gold: DataFrame) -> DataFrame:
    """(record_table, source, n_texts, n_cut, share) over the texts that aren't null or blank."""
    cases = truncated(posts, gold)
    one = posts.select(F.lit("posts").alias("record_table"), F.col("id").cast("bigint").alias("post_id"), F.lit(0).alias("round"), source_name(F.col("source")).alias("source"), F.col("content").alias("text"))
    two = gold.select(F.lit("gold_labels").alias("record_table"), F.col("post_id").cast("bigint").alias("post_id"), F.col("round").cast("int").alias("round"), source_name(F.col("source")).alias("source"), "text")
    texts = one.unionByName(two).filter(F.col("text").rlike(r"\S")).select("record_table", "post_id", "round", "source")
    marked = texts.join(cases.withColumn("hit", F.lit(1)), ["record_table", "post_id", "round"], "left")
    return marked.groupBy("record_table", "source").agg(F.count("*").alias("n_texts"), F.count("hit").alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_texts"))
