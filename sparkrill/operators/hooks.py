"""Models as callables: sentiment, theme, embedding, entailment and text generation over Arrow batches, with stand-ins that need no model.

A model takes a list of texts (entailment: two lists) and gives a list of results in the same order. It is made once for each task by a factory,
so that weights load where they are used; rows keep all their columns and are never reordered within a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from sparkrill.operators.sentiment import confident, label_of, signed
from sparkrill.operators.summaries import pick_theme

BATCH = 256
Model = Callable[..., list]


def applied(rows: DataFrame, inputs: list[str], output: str, kind: str, factory: Callable[[], Model], batch: int = BATCH) -> DataFrame:
    """rows with a column `output` of the given type: the model's results on the input columns, null inputs as empty texts."""
    kept = rows.schema
    type_: DataType = _parse_datatype_string(kind)
    schema = StructType([*kept.fields, StructField(output, type_)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        model, arrow = factory(), to_arrow_type(type_)
        for block in batches:
            for at in range(0, block.num_rows, batch):
                part = block.slice(at, batch)
                texts = [[t or "" for t in part.column(part.schema.get_field_index(c)).to_pylist()] for c in inputs]
                found = model(*texts)
                if len(found) != part.num_rows:
                    raise ValueError("a model must give one result for each row")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow)], [*part.schema.names, output])

    return rows.mapInArrow(run, schema)


def with_sentiment(rows: DataFrame, text: str, factory: Callable[[], Model] | None = None, temperature: float = 1.0) -> DataFrame:
    """rows with label, score, p_positive, p_neutral, p_negative, confident and signed. The model gives three logits; the temperature softens them."""
    scored = applied(rows, [text], "_logits", "array<double>", factory or (lambda: lexicon))
    exps = F.transform("_logits", lambda x: F.exp((x - F.array_max("_logits")) / F.lit(temperature)))
    total = F.aggregate(exps, F.lit(0.0), lambda s, x: s + x)
    p = [F.get(exps, F.lit(k)) / total for k in range(3)]
    rows = scored.withColumns({"p_positive": p[0], "p_neutral": p[1], "p_negative": p[2]}).drop("_logits")
    three = [F.col(c) for c in ("p_positive", "p_neutral", "p_negative")]
    found = rows.withColumn("_top", label_of(*three)).select("*", "_top.label", "_top.score").drop("_top")
    return found.withColumn("confident", confident(*three)).withColumn("signed", signed(F.col("label"), F.col("score")))


def with_theme(rows: DataFrame, text: str, themes: list[str], factory: Callable[[], Model] | None = None) -> DataFrame:
    """rows with theme: struct<label, confidence, confident, secondary> from the model's score of each theme."""
    scored = applied(rows, [text], "_scores", "array<double>", factory or (lambda: keyword_scores))
    pairs = F.map_from_arrays(F.array(*map(F.lit, themes)), "_scores")
    return scored.withColumn("theme", pick_theme(pairs, themes[-1])).drop("_scores")


def with_entailment(rows: DataFrame, premise: str, hypothesis: str, factory: Callable[[], Model] | None = None) -> DataFrame:
    """rows with entailment and contradiction, two shares of 1."""
    judged = applied(rows, [premise, hypothesis], "_nli", "array<double>", factory or (lambda: subset_entails))
    return judged.withColumn("entailment", F.get("_nli", F.lit(0))).withColumn("contradiction", F.get("_nli", F.lit(1))).drop("_nli")


def with_generated(rows: DataFrame, prompt: str, output: str, factory: Callable[[], Model] | None = None) -> DataFrame:
    """rows with the text that the model writes on each prompt; null counts as an empty text."""
    return applied(rows, [prompt], output, "string", factory or (lambda: first_sources), 16)


# Stand-ins.
GOOD = "good great love better best fast impressive helpful reliable".split()
BAD = "bad worse worst slow hate broken useless wrong terrible".split()
_GOOD, _BAD = (re.compile(rf"\b(?:{'|'.join(w)})\b", re.A) for w in (GOOD, BAD))


def lexicon(texts: list[str]) -> list[list[float]]:
    """Logits by words: the square roots of how many good and bad ones there are, and 1 for neutral."""
    return [[math.sqrt(len(_GOOD.findall(t.lower()))), 1.0, math.sqrt(len(_BAD.findall(t.lower())))] for t in texts]


KEYWORDS = [
    ["release", "version", "launch", "更新", "發布", "发布"],
    ["tool", "plugin", "open source", "工具", "外掛", "插件"],
    ["how to", "guide", "prompt", "tutorial", "使用", "教學"],
    ["bug", "fail", "hallucinat", "limit", "風險", "问题"],
    ["copyright", "law", "privacy", "regulation", "倫理", "法規"],
    [],
]


def keyword_scores(texts: list[str]) -> list[list[float]]:
    """For each theme 0.3 for each of its words that a text holds, at most 0.9."""
    return [[min(0.9, 0.3 * sum(w in t.lower() for w in words)) for words in KEYWORDS] for t in texts]


def subset_entails(premises: list[str], hypotheses: list[str]) -> list[list[float]]:
    """A hypothesis all of whose words the premise has is entailed; an empty one is not."""
    found = []
    for p, h in zip(premises, hypotheses):
        words, known = set(re.findall(r"[^\W_]+", h.lower())), set(re.findall(r"[^\W_]+", p.lower()))
        found.append([1.0 if words and words <= known else 0.0, 0.0])
    return found


def first_sources(prompts: list[str]) -> list[str]:
    """The first two numbered lines of a prompt, each as a sentence that cites itself."""
    found = []
    for prompt in prompts:
        lines = re.findall(r"(?m)^\[(\d+)\] (.+)$", prompt)[:2]
        found.append("\n".join(f"{text.rstrip('.。!！?？ ')} [{n}]." for n, text in lines))
    return found


def bag_of_words(dims: int = 64) -> Callable[[], Model]:
    """A factory of unit vectors of word counts hashed by md5."""

    def factory() -> Model:
        import hashlib

        def embed(texts: list[str]) -> list[list[float]]:
            vectors = []
            for text in texts:
                v = [0.0] * dims
                for word in re.findall(r"\w+", text.lower()):
                    v[int.from_bytes(hashlib.md5(word.encode()).digest()[-4:], "big") % dims] += 1
                length = math.sqrt(sum(x * x for x in v))
                vectors.append([x / length for x in v] if length else v)
            return vectors

        return embed

    return factory


def with_vectors(rows: DataFrame, text: str, factory: Callable[[], Model] | None = None) -> DataFrame:
    """rows with v, the model's vector of each text."""
    return applied(rows, [text], "v", "array<double>", factory or bag_of_words())


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))
