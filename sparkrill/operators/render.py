"""Small results as text: tables, pages, mails and paths of charts, from rows that reached the driver, and times in words."""

from __future__ import annotations

import html
from collections.abc import Sequence
from email.message import EmailMessage

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = (("day", 86400), ("hour", 3600), ("minute", 60))


def relative_time(time: Column, now: Column) -> Column:
    """A time before or after another as a whole number of its largest unit of at least one: '-3 day', '2 hour'. Halves round up."""
    seconds = F.floor((F.unix_micros(time) - F.unix_micros(now)) / 1_000_000 + 0.5)
    word = F.concat(seconds.cast("string"), F.lit(" second"))
    for unit, size in reversed(_UNITS):
        word = F.when(F.abs(seconds) >= size, F.concat(F.floor(seconds / size + 0.5).cast("string"), F.lit(f" {unit}"))).otherwise(word)
    return word


def markdown_table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """A Markdown table; bars in cells are escaped, nulls are empty."""

    def line(cells: Sequence[object]) -> str:
        return "| " + " | ".join("" if c is None else str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"

    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, rows)])


def html_page(title: str, sections: Sequence[tuple[str, Sequence[tuple[str, str | None]]]]) -> str:
    """A page of sections of titles with links; only http(s) addresses become links, all text is escaped."""

    def item(text: str, link: str | None) -> str:
        shown = html.escape(text)
        return f'<li><a href="{html.escape(link)}">{shown}</a></li>' if link and link.startswith(("http://", "https://")) else f"<li>{shown}</li>"

    body = "".join(f"<h2>{html.escape(head)}</h2><ul>{''.join(item(t, u) for t, u in items)}</ul>" for head, items in sections)
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'


def mail(subject: str, sender: str, receiver: str, plain: str, page: str) -> EmailMessage:
    """A message with a plain text and an HTML alternative."""
    message = EmailMessage()
    message["Subject"], message["From"], message["To"] = subject, sender, receiver
    message.set_content(plain)
    message.add_alternative(page, subtype="html")
    return message


def trend_path(values: Sequence[float | None], width: float, height: float, pad: float, low: float, high: float) -> str:
    """An SVG path over the values, evenly spaced between the pads; nulls are skipped, a range without extent lies on the ground."""
    step = (width - 2 * pad) / (len(values) - 1) if len(values) > 1 else 0.0
    points = [(pad + k * step, height - pad - ((v - low) / (high - low) * (height - 2 * pad) if high > low else 0.0)) for k, v in enumerate(values) if v is not None]
    return " ".join(f"{'L' if k else 'M'}{x:.1f},{y:.1f}" for k, (x, y) in enumerate(points))
