"""Source and account of a post, however the crawlers wrote them, as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_NO_ACCOUNT = ("", "[deleted]")


def _plain(text: Column) -> Column:
    """Full-width forms as ASCII, invisible characters gone, blanks trimmed, lower case."""
    text = F.regexp_replace(F.translate(text, _WIDE, _ASCII), r"\p{Cf}+", "")
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def _handle(text: Column) -> Column:
    """A handle without its display name in parentheses and without the prefixes u/, /u/ and @; null if there is none."""
    text = F.regexp_replace(_plain(text), r"(?U)\s*\([^)]*\)$", "")
    text = F.regexp_replace(text, r"(?U)^(?:/?u/|/?user/|@)\s*", "")
    return F.when(~text.isin(*_NO_ACCOUNT), text)


def source_name(source: Column) -> Column:
    """One of the eight source names; null stays null."""
    return F.regexp_extract(_plain(source), r"(?U)^([^@\s]*)", 1)


def account(author: Column, source: Column) -> Column:
    """The account of a post: from author, else from a handle that stands in source, else null."""
    return F.coalesce(_handle(author), _handle(F.regexp_extract(_plain(source), r"@(.+)$", 1)))
