"""Cited summaries of events: parsing, form checks, source numbers, gates for training records, knowledge packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrill.functions.text import event_key, parse_citations, split_summary
from sparkrill.operators.ranking import globally_ranked

# Citations and the lines that models put before a summary.
_CITATION = r"[\[［]\s*(\d+(?:\s*[,，、]\s*\d+)*)\s*[\]］]"
_PREAMBLE = r"(?i)^\s*(?:摘要|事件摘要|以下是?|這是?|here(?:'s| is)|summary)\s*[：:]?\s*$"
_LIST_MARK = r"^\s*(?:[-*•‧]|\d+[.)、])\s+"
STATUSES = ("no_key_sentences", "empty_summary", "format_issues", "low_faithfulness", "ok")


def extract_ids(text: Column) -> Column:
    """All cited numbers in order, repeated ones too, in half- or full-width brackets."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CITATION), F.lit(1))
    return F.transform(F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)))), lambda n: n.cast("int"))


def parse_summary(raw: Column) -> Column:
    """A model's output without code fence, preamble lines, blank lines and list marks."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    text = F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?```\s*$", "")).otherwise(text)
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(_PREAMBLE))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, _LIST_MARK, "")), "\n")


def summary_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[。！？!?；;\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def validated(rows: DataFrame, text: str, n_sources: str) -> DataFrame:
    """rows with issues: struct<ok, empty, uncited_sentences, out_of_range_ids> of a parsed summary."""

    def bare(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, _CITATION, ""))

    empty = bare(F.coalesce(F.col(text), F.lit(""))) == ""
    uncited = F.filter(summary_sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: (bare(s) != "") & (F.size(extract_ids(s)) == 0))
    wrong = F.array_sort(F.array_distinct(F.filter(extract_ids(F.col(text)), lambda i: (i < 1) | (i > F.col(n_sources)))))
    ok = ~empty & (F.size(uncited) == 0) & (F.size(wrong) == 0)
    return rows.withColumn("issues", F.struct(ok.alias("ok"), empty.alias("empty"), uncited.alias("uncited_sentences"), wrong.alias("out_of_range_ids")))


def citation_validity(rows: DataFrame, summary: str, n_sources: str) -> DataFrame:
    """rows with validity: struct<rate, n_sentences, uncited, out_of_range, cited_sources, coverage>."""
    sentences = split_summary(F.coalesce(F.col(summary), F.lit("")))

    def inside(s: Column) -> Column:
        return F.filter(parse_citations(s), lambda i: (i >= 1) & (i <= F.col(n_sources)))

    uncited = F.filter(sentences, lambda s: F.size(parse_citations(s)) == 0)
    wrong = F.filter(sentences, lambda s: (F.size(parse_citations(s)) > 0) & (F.size(inside(s)) == 0))
    n = F.size(sentences)
    rate = F.when(n > 0, (n - F.size(uncited) - F.size(wrong)) / n).otherwise(F.lit(0.0))
    cited = F.array_sort(F.array_distinct(F.flatten(F.transform(sentences, inside))))
    coverage = F.when(F.col(n_sources) > 0, F.size(cited) / F.col(n_sources)).otherwise(F.lit(0.0))
    return rows.withColumn("validity", F.struct(rate.alias("rate"), n.alias("n_sentences"), uncited.alias("uncited"), wrong.alias("out_of_range"), cited.alias("cited_sources"), coverage.alias("coverage")))


def numbered_sources(sentences: DataFrame) -> DataFrame:
    """sentences (event, pos, post_id, ...) with source_id: the posts of an event numbered from 1 by their first sentence; one without a post is its own source."""
    key = F.coalesce(F.concat(F.lit("p"), F.col("post_id").cast("string")), F.concat(F.lit("s"), F.col("pos").cast("string")))
    firsts = sentences.groupBy("event", key.alias("_key")).agg(F.min("pos").alias("_first"))
    ranked = firsts.withColumn("source_id", F.row_number().over(W.partitionBy("event").orderBy("_first")))
    return sentences.withColumn("_key", key).join(ranked.drop("_first"), ["event", "_key"]).drop("_key")


def prompt_of(sources: Column, most: int = 8, language: str = "zh-Hant") -> Column:
    """The prompt for a summary of numbered source lines that cites them."""
    rules = f"Summarise the event in at most {most} sentences, in the language {language}. Use only facts of the numbered sources. End each sentence with the numbers that support it, as [n] or [n][m]. Leave out what no source supports.\n\nSources:\n"
    return F.concat(F.lit(rules), sources, F.lit("\n\nSummary:\n"))


def source_block(sentences: DataFrame) -> DataFrame:
    """(event, sources): the numbered lines [n] text that a prompt shows, in order."""
    line = F.concat(F.lit("["), F.row_number().over(W.partitionBy("event").orderBy("pos")).cast("string"), F.lit("] "), F.regexp_replace(F.trim("text"), "\n", " "))
    return sentences.withColumn("_line", line).groupBy("event").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_line"))), lambda s: s["_line"]), "\n").alias("sources"))


def gated_records(rows: DataFrame, min_faithfulness: float = 0.5, require_ok: bool = True) -> DataFrame:
    """rows (n_sentences, issues, faithfulness_score, post_ids) with status and event_key: the first gate that stops a record, else ok. A null score wasn't checked."""
    status = F.when(F.coalesce("n_sentences", F.lit(0)) == 0, STATUSES[0]).when(F.col("issues.empty"), STATUSES[1])
    if require_ok:
        status = status.when(~F.col("issues.ok"), STATUSES[2])
    status = status.when(F.col("faithfulness_score") < min_faithfulness, STATUSES[3]).otherwise(STATUSES[4])
    return rows.withColumn("status", status).withColumn("event_key", event_key(F.col("post_ids")))


def pick_theme(scores: Column, other: str, least: float = 0.45, second: float = 0.40) -> Column:
    """struct<label, confidence, confident, secondary> of a map of theme scores; below `least` the theme is `other`."""
    ranked = F.reverse(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("score"), e["key"].alias("name")))))
    top, runner = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    sure = F.coalesce(top["score"] >= least, F.lit(False))
    return F.struct(F.when(sure, top["name"]).otherwise(other).alias("label"), top["score"].alias("confidence"), sure.alias("confident"), F.when(sure & (runner["score"] >= second), runner["name"]).alias("secondary"))


def first_match(raw: Column, labels: dict[str, str]) -> Column:
    """The label whose key stands first in a text, of equal places the earlier key; null if none does."""
    text = F.lower(F.coalesce(raw, F.lit("")))
    places = F.array(*[F.struct(F.locate(key, text).alias("at"), F.lit(k).alias("k"), F.lit(label).alias("label")) for k, (key, label) in enumerate(labels.items())])
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))["label"]


def event_number(key: Column) -> Column:
    """A negative id of an event key: 32-bit FNV-1a over its characters, negated, less one."""
    codes = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    hashed = F.aggregate(codes, F.lit(0x811C9DC5).cast("bigint"), lambda h, c: ((h.bitwiseXOR(c)) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return -hashed - 1


def knowledge_pack(posts: DataFrame, themes: list[str]) -> DataFrame:
    """(theme, n, line): the posts (id, theme, title, source, url) of each theme as lines with source numbers; unknown themes are the last.

    Numbers come from ranks over range partitions: a theme may have any number of posts.
    """
    theme = F.when(F.col("theme").isin(*themes), F.col("theme")).otherwise(themes[-1])
    place = F.element_at(F.create_map(*[x for k, t in enumerate(themes) for x in (F.lit(t), F.lit(k))]), theme)
    ranked = globally_ranked(posts.select("id", theme.alias("theme"), place.alias("_t"), "title", "source", "url"), [F.col("_t"), F.col("id")])
    firsts = ranked.groupBy("_t").agg(F.min("rank").alias("_first"))
    n = F.col("rank") - F.col("_first") + 1
    source = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("（"), F.col("source"), F.lit("）"))).otherwise("")
    head = F.concat(F.lit("- **"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("(untitled)")), F.lit("**"), source, F.lit(" ["), n.cast("string"), F.lit("]"))
    line = F.concat(head, F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("\n  - "), F.col("url"))).otherwise(""))
    return ranked.join(F.broadcast(firsts), "_t").select("theme", n.alias("n"), line.alias("line"))


def fitted_temperature(rows: DataFrame, logits: str, label: str, low: float = 0.05, high: float = 20.0, rounds: int = 40) -> float:
    """The temperature that minimises the mean negative log-likelihood of rows (logits array<double>, label index), by golden section; each probe is one aggregate."""

    def loss(t: float) -> float:
        scaled = F.transform(logits, lambda x: x / F.lit(t))
        top = F.array_max(scaled)
        total = F.aggregate(F.transform(scaled, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
        return rows.agg(F.avg(F.ln(total) + top - F.get(scaled, F.col(label)))).first()[0] or 0.0

    import math

    shrink = (math.sqrt(5) - 1) / 2
    a, b = math.log(low), math.log(high)
    c, d = b - shrink * (b - a), a + shrink * (b - a)
    fc, fd = loss(math.exp(c)), loss(math.exp(d))
    for _ in range(rounds):
        if b - a < 1e-4:
            break
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - shrink * (b - a)
            fc = loss(math.exp(c))
        else:
            a, c, fc = c, d, fd
            d = a + shrink * (b - a)
            fd = loss(math.exp(d))
    return math.exp((a + b) / 2)
