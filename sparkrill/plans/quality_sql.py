"""The quality rules as one DuckDB statement. DuckDB's patterns know word boundaries in ASCII only: texts are mapped to ASCII for them, other word
characters to an underscore, other blanks to a blank, all else to an exclamation mark."""

from __future__ import annotations

from sparkrill.functions.text import ALIASES
from sparkrill.operators import quality as Q

_WORD = r"\p{L}\p{M}\p{N}\p{Pc}"
_BLANK = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _pattern(java: str) -> str:
    """A pattern of the rules for DuckDB."""
    return _quoted(java.replace("(?iU)", "(?i)").replace("(?U)", ""))


def _has(text: str, java: str) -> str:
    return f"regexp_matches({text}, '{_pattern(java)}')"


def _count(text: str, java: str) -> str:
    return f"len(regexp_extract_all({text}, '{_pattern(java)}'))"


def _ascii(text: str) -> str:
    # These letters are ASCII ones in another case.
    text = f"translate({text}, '\u0131\u0130\u017f\u212a', 'iisk')"
    return rf"regexp_replace(regexp_replace(regexp_replace({text}, '[{_BLANK}]', ' ', 'g'), '[^\x00-\x7f{_WORD}]', '!', 'g'), '[^\x00-\x7f]', '_', 'g')"


def _unescaped(text: str) -> str:
    for entity, plain in (("&#x27;", "''"), ("&#39;", "''"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&amp;", "&"), ("&amp", "&")):
        text = f"replace({text}, '{entity}', '{plain}')"
    return text


def _listed(values: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_MENTIONS = {slug: rf"(?i)\b(?:{'|'.join(names)})\b" for slug, names in ALIASES.items()}
_OWN = " OR ".join(f"(w IN ({_listed(names)}) AND list_contains(models, '{slug}'))" for slug, names in ALIASES.items())
_IN_TITLE = " OR ".join(f"(list_contains(models, '{slug}') AND {_has('title_a', p)})" for slug, p in _MENTIONS.items())
_HITS = ", ".join(f"CASE WHEN list_contains(models, '{slug}') THEN {_count('visible_a', p)} ELSE 0 END" for slug, p in _MENTIONS.items())
# The off-topic pattern has words within boundaries, and signs and Chinese words without.
_OFF_WORDS = Q.OFF_TOPIC[Q.OFF_TOPIC.index(r"\b(aries") : Q.OFF_TOPIC.index("|星座")]
_OFF_SIGNS = Q.OFF_TOPIC[len("(?iU)(") : Q.OFF_TOPIC.index(r"|\b(aries")] + Q.OFF_TOPIC[Q.OFF_TOPIC.index("|星座") : -1]
_CONTEXT = f"({_has('visible_a', Q.DISCUSSION)} OR {_has('visible_a', Q.AI_CONTEXT)} OR {_has('visible', Q.AI_CONTEXT_ZH)} OR {_has('visible_a', Q.AS_PRODUCT)})"
_GONE = r"(?i)^\s*\[(deleted|removed)\]\s*$"
_FLAGS = {
    "TOO_SHORT": f"length(regexp_replace(regexp_replace(visible, '^[\\s\\x0b{_BLANK}]+|[\\s\\x0b{_BLANK}]+$', '', 'g'), '[\\s\\x0b{_BLANK}]+', ' ', 'g')) < {Q.MIN_SUBSTANCE}",
    "LINK_HEAVY": f"coalesce(list_sum(list_transform(regexp_extract_all(content, '{_pattern(Q.URL)}'), lambda u: length(u))), 0) > {Q.MAX_LINKS} * length(content)",
    "EMOJI_SPAM": f"{_count('raw', Q.EMOJI)} > {Q.MAX_EMOJI}",
    "ALL_CAPS": f"len(words) >= 4 AND len(list_filter(words, lambda w: w = upper(w))) / len(words) > {Q.MAX_CAPS}",
    "EXCESSIVE_PUNCT": _has("raw", r"[!?]{3,}|!{5,}"),
    "SPAM_PHRASE": "promo >= 2",
    "AD": f"promo >= 1 AND {_has('raw_a', Q.CTA)}",
    "SEO": rf"coalesce(list_max(map_values(list_histogram(stuff))) >= {Q.STUFF_REPEAT} AND list_max(map_values(list_histogram(stuff))) / len(stuff) > {Q.STUFF_SHARE}, false) OR len(regexp_extract_all(raw, '(?:^|[^{_WORD}&])#[{_WORD}]+')) >= 3 OR {_has('title_a', Q.SEO_LIST)}",
    "AFFILIATE": f"promo >= 1 AND {_has('raw_a', Q.AFFILIATE)}",
    "CLICKBAIT": _has("title_a", Q.CLICKBAIT),
    "JOB_POSTING": _has("raw_a", Q.JOB),
    "LIKELY_BOT": f"coalesce({_has('author', Q.BOT.replace('$', '(?:' + chr(92) + 'r?' + chr(92) + 'n)?$'))}, false)",
    "KEYWORD_NOT_IN_BODY": "len(models) > 0 AND hits = 0",
    "OFF_TOPIC": "off_topic",
    "WEAK_KEYWORD": f"len(models) > 0 AND hits = 1 AND NOT off_topic AND NOT ({_IN_TITLE})",
    "SARCASM_DETECTED": _has("raw_a", Q.SARCASM),
}
_POINTS = " + ".join(f"CASE WHEN list_contains(flags, '{name}') THEN {points} ELSE 0 END" for name, points in Q.DEDUCTIONS.items())
DQ_SCORES = f"""
WITH p AS (SELECT id, source, author, coalesce(models, []) AS models, {_unescaped("trim(coalesce(title, ''), ' ')")} AS title, regexp_replace({_unescaped("coalesce(content, '')")}, '<[^>]+>', ' ', 'g') AS content FROM posts),
b AS (SELECT *, title || chr(10) || content AS raw, title || chr(10) || regexp_replace(regexp_replace(regexp_replace(content, '(?s)```.*?```|`[^`]+`', ' ', 'g'), '\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '{_pattern(Q.URL)}', ' ', 'g') AS visible FROM p),
a AS (SELECT *, {_ascii('title')} AS title_a, {_ascii('raw')} AS raw_a, {_ascii('visible')} AS visible_a, regexp_extract_all(raw, '[A-Za-z]{{3,}}') AS words, list_filter(regexp_extract_all(lower(raw), '[a-z]{{4,}}'), lambda w: NOT (w IN ({_listed(Q.STUFFING_STOPWORDS)})) AND NOT ({_OWN})) AS stuff FROM b),
c AS (SELECT *, {_count('raw_a', Q.PROMO)} AS promo, greatest({_HITS}) AS hits FROM a),
o AS (SELECT *, len(models) > 0 AND hits > 0 AND len(list_filter(models, lambda m: NOT (m IN ({_listed(Q.AMBIGUOUS)})))) = 0 AND lower(coalesce(source, '')) NOT IN ({_listed(Q.TECH_SOURCES)}) AND ({_has('visible_a', '(?i)' + _OFF_WORDS)} OR {_has('visible', '(?i)' + _OFF_SIGNS)}) AND NOT {_CONTEXT} AS off_topic FROM c),
f AS (SELECT id, CASE WHEN {_has('title', _GONE)} OR {_has('content', _GONE)} THEN ['DELETED'] ELSE list_sort(list_filter([{", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _FLAGS.items())}], lambda x: x IS NOT NULL)) END AS flags FROM o)
SELECT id, CASE WHEN list_contains(flags, 'DELETED') THEN 0 ELSE greatest(0, 100 - ({_POINTS})) END AS quality_score, flags AS quality_flags FROM f
"""
