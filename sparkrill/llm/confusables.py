"""One consistent form for texts that look the same, and the skeleton by which such texts meet.

`consistent` replaces what stands for ordinary text in another form: compatibility letters and digits
(full-width, mathematical, ligatures, half-width kana, radicals), look-alike letters of other scripts,
invisible characters, unusual blanks and hyphens, decomposed accents. It leaves what is ordinary writing:
CJK punctuation, composed accents, emoji with joiners and selectors, typographic quotes and dots, line breaks.

`skeleton` is for comparison only: decompose, replace every character by its prototype, decompose again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrill.storage import written

# Letters of other scripts, and rare Latin ones, with the Latin letter each looks like.
LOOK_ALIKE = dict(
    zip(
        "аеорсухіјѕԁԛԝһӏ" "АВЕКМНОРСТУХІЈЅԌԚԜҺӀ" "αινορυχκτ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ıɑɡɩʋᴏᴄᴠᴡᴢօսոհց"
        # Cherokee, Lisu, Coptic.
        "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" "ⲀⲂⲈⲌⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ" "ⲟⲣⲥⲭ",
        "aeopcyxijsdqwhl" "ABEKMHOPCTYXIJSGQWHI" "aivopuxkt" "ABEZHIKMNOPTYX" "iagivocvwzounhg"
        "DRTAJEWMHYGZRWSVSLCPKB" "BPDTGKJCZFMNLSRVHWXYAEIOU" "ABEZHIKMNOPCTYX" "opcx",
        strict=True,
    )
)
# Prototypes within ordinary text, for the skeleton only.
PROTOTYPE = {"0": "O", "1": "l", "I": "l", "|": "l", "m": "rn", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "　": " "}
HYPHENS = "‐‑"
JOINERS = "‌‍"
SELECTORS = "︎️"
TURKISH = re.compile("[ğĞşŞİ]")
_PLAIN = re.compile("[\x00-\x7e¡-¬®-´¶-İĴ-ľŁ-ňŊ-žƀ-ǃ–-„…　-゘゛-ヿ一-鿿！（），：；？]*")
#: The same class for the JVM: a text of only these characters is in its consistent form, unless it has combining marks.
PLAIN_JAVA = r"[^\x00-\x7e¡-¬®-´¶-İĴ-ľŁ-ňŊ-žƀ-ǃ–-„…　-゘゛-ヿ一-鿿！（），：；？]"


@lru_cache(maxsize=1)
def replacements() -> dict[int, str]:
    """Code point to its ordinary form, built by rule from the character database and LOOK_ALIKE.

    The rule takes letters, digits, blanks and radicals with a font, width, no-break, circle or compatibility
    decomposition; super- and subscripts, fractions and punctuation stay as they are.
    """
    table: dict[int, str] = {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Zs" and c != "　":
            table[code] = " "
        elif kind == "Cf" and c not in JOINERS and not 0x600 <= code <= 0x8FF and not 0xE0000 <= code:
            table[code] = ""
        elif (parts := unicodedata.decomposition(c)).startswith("<"):
            tag = parts[1 : parts.index(">")]
            # A Roman numeral of one letter is that letter.
            letter = kind[0] == "L" or kind == "Nl" and len(found := parts.split()) == 2 and int(found[1], 16) < 0x80 or kind == "Nd" or kind == "So" and (0x2E80 <= code <= 0x2FDF or tag == "circle" and 0x24B6 <= code <= 0x24E9)
            if letter and tag in ("font", "wide", "narrow", "compat", "circle") and not 0x1100 <= code <= 0x11FF and not 0x3131 <= code <= 0x318E:
                table[code] = unicodedata.normalize("NFKC", c)
            elif tag in ("wide", "narrow") and (kind == "Lm" or 0xFF61 <= code <= 0xFF9F):
                table[code] = unicodedata.normalize("NFKC", c)
    for c in HYPHENS:
        table[ord(c)] = "-"
    return table


@lru_cache(maxsize=1)
def _suspects() -> tuple[frozenset[str], frozenset[str]]:
    table = frozenset(map(chr, replacements()))
    return table, frozenset(LOOK_ALIKE)


_WORD = re.compile(r"[^\W\d_]+")


def _is_foreign(c: str) -> bool:
    return "Ͱ" <= c <= "ԯ" or "Ա" <= c <= "֏" or "Ꭰ" <= c <= "ᏽ" or "Ⲁ" <= c <= "⳿" or "ꓐ" <= c <= "꓿"


def _latin_word(found: re.Match[str]) -> str:
    """A word whose look-alikes stand for Latin letters, in Latin: not one with letters that only its own script has."""
    word = found[0]
    if any(_is_foreign(c) and c not in LOOK_ALIKE for c in word):
        return word
    return "".join([LOOK_ALIKE.get(c, c) for c in word])


def _turkish_word(found: re.Match[str]) -> str:
    return "ı".join([_WORD.sub(_latin_word, part) for part in found[0].split("ı")]) if not any(_is_foreign(c) and c not in LOOK_ALIKE for c in found[0]) else found[0]


def _without_stray_marks(text: str) -> str:
    """Joiners and variation selectors stay where they shape an emoji, an ideograph or a script that needs them."""
    kept: list[str] = []
    for i, c in enumerate(text):
        if c in JOINERS or c in SELECTORS:
            earlier = kept[-1] if kept else " "
            code = ord(earlier)
            emoji = unicodedata.category(earlier) in ("So", "Sk", "Sm", "Mn") or earlier in "#*0123456789‼⁉〰〽"
            if c in SELECTORS and not emoji or c == "‍" and not (emoji or 0x600 <= code <= 0xDFF) or c == "‌" and not 0x600 <= code <= 0xDFF:
                continue
        kept.append(c)
    return "".join(kept)


def consistent(text: str | None) -> str | None:
    """The consistent form of a text; null stays null, an empty text empty. Applied twice it changes nothing more."""
    if not text or _PLAIN.fullmatch(text):
        return text
    table, alike = _suspects()
    result = text
    if not table.isdisjoint(result):
        result = result.translate(replacements())
    if not alike.isdisjoint(result):
        # In a Turkish text the dotless i is a letter of its own.
        result = _WORD.sub(_turkish_word if TURKISH.search(result) else _latin_word, result)
    if any(c in result for c in JOINERS + SELECTORS):
        result = _without_stray_marks(result)
    return unicodedata.normalize("NFC", result)


@lru_cache(maxsize=1)
def _prototypes() -> tuple[dict[int, str], dict[int, str]]:
    letters = {**replacements(), **{ord(c): letter for c, letter in LOOK_ALIKE.items()}}
    return letters, {ord(c): p for c, p in PROTOTYPE.items()}


def skeleton(text: str | None) -> str | None:
    """Equal for texts that look the same. Null stays null."""
    if not text:
        return text
    letters, ordinary = _prototypes()
    result = text
    if not text.isascii():
        result = _without_stray_marks(unicodedata.normalize("NFD", text)).translate(letters)
    return unicodedata.normalize("NFD", result.translate(ordinary))


def fields_of(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, text): one row for each text column of each row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    return rows.select(F.col(id_col).alias("id"), F.explode(pairs).alias("p")).select("id", "p.field", "p.text")


def may_differ(text: Column) -> Column:
    """False only for texts that surely are in their consistent form; decided in the JVM."""
    # A text of ASCII alone has as many bytes as characters.
    return (F.octet_length(text) != F.length(text)) & text.rlike(PLAIN_JAVA)


def consistent_texts(texts: DataFrame, with_skeleton: bool = True) -> DataFrame:
    """(id, field, text) to (id, field, form, skeleton, affected).

    form: the text in its consistent form; skeleton: 64-bit hash of its skeleton, by which look-alikes meet
    (null for a null text); affected: whether text and form differ. Narrow; texts in plain characters skip
    the replacement, all texts are processed whole.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(2).to_pylist()
            forms = [consistent(t) for t in before]
            keys = [None if t is None or not with_skeleton else xxhash.xxh64_intdigest(skeleton(t).encode("utf-8", "surrogatepass")) - (1 << 63) for t in before]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string()), pa.array(keys, pa.int64()), pa.array([a != b for a, b in zip(before, forms)])], ["id", "field", "form", "skeleton", "affected"])

    return texts.select(F.col("id").cast("bigint").alias("id"), "field", "text").mapInArrow(run, "id bigint, field string, form string, skeleton bigint, affected boolean")


def affected_fields(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field) of the texts that are not an ordinary one of their skeleton's group.

    Originals are grouped by equal skeleton, with their consistent forms beside them; a text is affected if its group has ordinary forms
    and it is none of them. A form that would alter the look has another skeleton, so that such a change is no case. Texts of plain characters
    are their own form and need no look. Repeated rows give repeated rows; null and empty texts are no case.
    """
    import xxhash

    def key(text: str) -> int:
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(2).to_pylist()
            forms = [consistent(t) for t in before]
            columns = [[key(x) for x in texts] for texts in ([skeleton(t) for t in before], before, [skeleton(f) for f in forms], forms)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], ["id", "field", "skeleton", "text", "form_skeleton", "form"])

    texts = fields_of(rows, id_col, fields).filter(may_differ(F.col("text")))
    found = texts.select(F.col("id").cast("bigint").alias("id"), "field", "text").mapInArrow(run, "id bigint, field string, skeleton bigint, text bigint, form_skeleton bigint, form bigint")
    groups = written(found, "look-alikes")
    ordinary = groups.select(F.col("form_skeleton").alias("skeleton"), F.col("form").alias("text")).distinct()
    odd = groups.select("id", "field", "skeleton", "text").join(ordinary, ["skeleton", "text"], "left_anti")
    return odd.join(ordinary.select("skeleton").distinct(), "skeleton", "left_semi").select("id", "field")


def look_alike_groups(texts: DataFrame) -> DataFrame:
    """(skeleton, n_texts, n_forms, first_id) of texts (id, field, text): groups of equal skeleton that hold at least two different originals.

    Counts are exact and pre-aggregated, so one skeleton may hold any share of the rows. Null texts take no part.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [xxhash.xxh64_intdigest(skeleton(t).encode("utf-8", "surrogatepass")) - (1 << 63) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(2), batch.column(0)], ["skeleton", "original", "id"])

    filled = texts.filter("text is not null").select(F.col("id").cast("bigint").alias("id"), "text", F.xxhash64("text").alias("original"))
    per_form = filled.mapInArrow(run, "skeleton bigint, original bigint, id bigint").groupBy("skeleton", "original").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return per_form.groupBy("skeleton").agg(F.sum("n").alias("n_texts"), F.count("*").alias("n_forms"), F.min("first_id").alias("first_id")).filter("n_forms > 1")
