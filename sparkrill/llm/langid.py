"""Languages of documents and their lines by compression: the language whose dictionary makes the text smallest.

Each language has a zstandard raw-content dictionary of labelled texts. A line is compressed with the dictionary of each
language of its script; the smallest size wins, and a narrow margin is no decision. The dictionaries are
fitted on a bounded sample of labelled rows (SAMPLE of each language), whose wrong labels are weeded out by
compressing each half of the sample with the dictionaries of the other. All texts are classified whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATIN = ("en", "es", "pt", "de", "fr")
CJK = ("ja", "zh-Hant", "zh-Hans")
LANGUAGES = LATIN + CJK
SAMPLE = 256  # labelled rows of each language
DICTIONARY_BYTES = 40_000  # of each language at most
LEVEL = 3
MARGIN = 0.04  # of the size, between the best language and the next
LINE_MARGIN = 0.1  # for a line in another language than its text
MIN_WEIGHT = 24  # letters a line needs; a CJK character counts three
MIN_CHARACTERS = 80

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_LINK = re.compile(r"(?:https?://|www\.)\S+")
_MARK = re.compile(r"(?:(?<=\s)|(?<=^))[#@＃][^\s#@]+", re.M)
_ENTITY = re.compile(r"&(?:[a-z]+|#\d+|#x[0-9a-f]+);", re.I)
_HAN_KANA = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_LETTER = re.compile(r"[A-Za-zÀ-ɏ]")
_OTHER = re.compile(r"[^\W\d_A-Za-zÀ-ɏ぀-ヿ㐀-䶿一-鿿]")
_DIGITS = re.compile(r"\d+")


def language_of_label(label: Column) -> Column:
    """One of LANGUAGES, another lower-case code as it is, or null for a missing label (null, empty, und)."""
    code = F.regexp_replace(F.lower(F.trim(label)), "_", "-")
    first = F.split(code, "-")[0]
    return (
        F.when(code.isin("", "und", "unknown"), F.lit(None))
        .when(code.rlike(r"^zh-(hant|tw|hk|mo)"), "zh-Hant")
        .when(code.rlike(r"^zh(-|$)"), "zh-Hans")
        .otherwise(first)
    )


def prose(text: str) -> str:
    """Text without code, links, tags, mark-up and entities; line breaks stay."""
    if "`" in text:
        text = _INLINE.sub(" ", _FENCE.sub("\n", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if "://" in text or "www." in text:
        text = _LINK.sub(" ", text)
    if "#" in text or "@" in text or "＃" in text:
        text = _MARK.sub(" ", text)
    return text


def script(line: str) -> tuple[tuple[str, ...], int]:
    """The languages of a line's script, and the weight of its letters: none for a line mostly in another script."""
    if line.isascii():
        return LATIN, len(_LETTER.findall(line))
    wide = 3 * len(_HAN_KANA.findall(line))
    narrow = len(_LETTER.findall(line))
    if (other := len(_OTHER.findall(line))) > max(wide, narrow):
        return (), other
    return (CJK, wide + narrow) if wide > narrow else (LATIN, wide + narrow)


def _bytes(line: str) -> bytes:
    return _DIGITS.sub("0", line.lower()).encode("utf-8", "ignore")


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.press = {}
        for language, data in dictionaries.items():
            if len(data) >= 8:
                own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=LEVEL)
                self.press[language] = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def line(self, line: str) -> tuple[str | None, float, dict[str, int], int]:
        """Language (null: too short or no dictionary of its script), margin, sizes, weight."""
        languages, weight = script(line)
        if weight < MIN_WEIGHT:
            return None, 0.0, {}, weight
        data = _bytes(line)
        sizes = {name: len(press(data)) for name, press in ((n, self.press.get(n)) for n in languages) if press}
        if not sizes:
            return None, 0.0, {}, weight
        ranked = sorted(sizes, key=lambda n: (sizes[n], n))
        margin = 1 - sizes[ranked[0]] / sizes[ranked[1]] if len(ranked) > 1 else 1.0
        return ranked[0], margin, sizes, weight

    def segments(self, text: str) -> tuple[str | None, float, list[tuple[int, int, str, float]]]:
        """The main language of a text with its confidence, and its segments: first and last line, language, confidence.

        Lines in a row of one language are a segment. A line too short to decide, or not clearly in another language than the
        text, goes with its text. Without any decision the language is null and there is no segment.
        """
        lines = prose(text).split("\n")
        if len(lines) > 1:
            judged = [self.line(line) for line in lines]
            totals: dict[str, int] = defaultdict(int)
            for name, _, _, weight in judged:
                if name:
                    totals[name] += weight
            if not totals:
                judged, lines = [self.line(" ".join(lines))], [text]
        else:
            judged = [self.line(lines[0])]
        totals = defaultdict(int)
        for name, _, _, weight in judged:
            if name:
                totals[name] += weight
        if not totals:
            return None, 0.0, []
        # The main language: by the sizes of all lines of its script together, where scripts don't differ.
        script_of = {n: LATIN if n in LATIN else CJK for n in totals}
        heaviest = max(totals, key=lambda n: (sum(w for m, w in totals.items() if script_of[m] == script_of[n]), n))
        sums: dict[str, int] = defaultdict(int)
        for name, _, sizes, _ in judged:
            if name and script_of[name] == script_of[heaviest]:
                for m, size in sizes.items():
                    sums[m] += size
        main = max(totals, key=lambda n: (totals[n], n)) if len(totals) > 1 else heaviest
        ranked = sorted(sums, key=lambda n: (sums[n], n))
        if len(totals) == 1:
            main = ranked[0]
        confidence = 1 - sums[ranked[0]] / sums[ranked[1]] if len(ranked) > 1 else 1.0
        if len(totals) == 1 and confidence < MARGIN:
            return None, confidence, []
        found: list[tuple[int, int, str, float]] = []
        for at, (name, margin, sizes, weight) in enumerate(judged):
            own = main
            if found and not weight:
                found[-1] = (found[-1][0], at, *found[-1][2:])
                continue
            if name and name != main and (main not in sizes or sizes[name] < (1 - LINE_MARGIN) * sizes[main] and margin >= MARGIN):
                own = name
            sure = margin if own == name else 0.0
            if found and found[-1][2] == own:
                found[-1] = (found[-1][0], at, own, max(found[-1][3], sure))
            else:
                found.append((at, at, own, sure))
        return main, confidence, found


def fit(texts: list[tuple[str, str]]) -> dict[str, bytes]:
    """Dictionaries from (label, text) pairs, part of them labelled wrongly. Deterministic for a list in the same order."""
    lines = [(label, half % 2, line) for half, (label, text) in enumerate(texts) for line in prose(text).split("\n") if script(line)[1] >= MIN_WEIGHT]
    lines = [(label, half, line) for label, half, line in lines if label in script(line)[0]]

    def dictionaries(chosen: list[tuple[str, int, str]]) -> dict[str, bytes]:
        parts: dict[str, list[bytes]] = defaultdict(list)
        room: dict[str, int] = defaultdict(lambda: DICTIONARY_BYTES)
        for label, _, line in chosen:
            data = _bytes(line) + b"\n"
            if room[label] >= len(data):
                parts[label].append(data)
                room[label] -= len(data)
        return {label: b"".join(p) for label, p in parts.items()}

    for _ in range(2):
        kept = []
        for half in (0, 1):
            judge = Classifier(dictionaries([x for x in lines if x[1] != half]))
            kept += [x for x in lines if x[1] == half and judge.line(x[2])[0] in (x[0], None)]
        lines = kept
    return dictionaries(lines)


def labelled_sample(posts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `sample` labelled texts of each of LANGUAGES: of each of `sample` hash buckets the row of the lowest hash.

    The ids come from the labels alone by a partial aggregation; only those at most 8 * sample texts reach the driver.
    """
    named = labels.select(F.col("post_id").cast("bigint").alias("id"), language_of_label(F.col("lang")).alias("label")).filter(F.col("label").isin(*LANGUAGES) & F.col("id").isNotNull())
    hashed = named.withColumn("h", F.xxhash64("id"))
    chosen = hashed.groupBy("label", F.pmod("h", F.lit(sample)).alias("bucket")).agg(F.min("h").alias("h"))
    picked = hashed.join(F.broadcast(chosen), ["label", "h"]).select("id", "label").distinct()
    texts = posts.select(F.col("id").cast("bigint").alias("id"), F.col("content").alias("text")).join(F.broadcast(picked), "id").filter("text is not null")
    return [(r.label, r.text) for r in sorted(texts.collect(), key=lambda r: (r.id, r.label, r.text))]


def languages(rows: DataFrame, id_col: str, text_col: str, dictionaries: dict[str, bytes]) -> DataFrame:
    """(id, lang, confidence, segments array<struct<first_line, last_line, lang, confidence>>) of each row. Narrow.

    lang is the main language, null where the text is null, empty, too short or undecided; then there is no segment. The
    confidence is the share by which the best dictionary beats the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        kind = pa.list_(pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for batch in batches:
            found = [judge.segments(t) if t else (None, 0.0, []) for t in batch.column(1).to_pylist()]
            segments = [[{"first_line": a, "last_line": b, "lang": n, "confidence": c} for a, b, n, c in s] for _, _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(segments, kind)], ["id", "lang", "confidence", "segments"])

    texts = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id bigint, lang string, confidence double, segments array<struct<first_line:int,last_line:int,lang:string,confidence:double>>")


def relabelled(posts: DataFrame, labels: DataFrame, min_characters: int = MIN_CHARACTERS) -> DataFrame:
    """(post_id, lang): the languages of each post whose label is missing or wrong, or whose lines are in several languages.

    A label counts from min_characters on, lines in several languages at any length. Undecided posts are no case. Several labels of one post count as right if one is.
    """
    dictionaries = fit(labelled_sample(posts, labels))
    long = F.coalesce(F.length("content") >= min_characters, F.lit(False))

    def judged_texts(texts: DataFrame) -> DataFrame:
        return languages(texts, "id", "content", dictionaries).filter("lang is not null").select("id", "lang", F.array_distinct(F.expr("transform(segments, s -> s.lang)")).alias("langs"))

    named = labels.select(F.col("post_id").cast("bigint").alias("id"), language_of_label(F.col("lang")).alias("label")).filter("label is not null and id is not null").distinct().groupBy("id").agg(F.collect_set("label").alias("labels"))
    judged = judged_texts(posts.filter(long)).join(named, "id", "left")
    case = (F.size("langs") > 1) | F.col("labels").isNull() | ~F.array_contains("labels", F.col("lang"))
    # A short text of one line can't be in several languages.
    short = judged_texts(posts.filter(~long & F.col("content").contains("\n"))).filter(F.size("langs") > 1)
    cases = judged.filter(case).select("id", "langs").unionByName(short.select("id", "langs"))
    return cases.select(F.col("id").alias("post_id"), F.explode("langs").alias("lang")).distinct()
