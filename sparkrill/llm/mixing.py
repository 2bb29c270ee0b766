"""Mixing sources to target shares of tokens, with soft memberships for documents without a stated source.

A naive-Bayes classifier, fitted on a bounded sample of documents with a source, gives the others posteriors over the sources. A document's
rate is how often it is used; projected-gradient least squares over all documents, in bundles of equal membership and limit,
fits rates between 0 and the limit whose expected token totals per source match the targets at the largest total that the
limits allow. Rates become whole copies: the whole part for every document, the rest in hash order up to an exact token count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrill.llm.bisect import cutoffs
from sparkrill.llm.byte_bpe import encoder
from sparkrill.llm.tokenizer_files import BYTE_BPE, TOKENIZERS, ship
from sparkrill.storage import written

SAMPLE = 256  # documents of each source for the classifier
FEATURES = 1 << 12
EVIDENCE = 40.0  # tokens' worth of evidence a document counts at most, so that posteriors stay soft
GRID = 16  # posteriors are rounded to this many parts, which bounds the number of bundles
TOLERANCE = 1e-6  # of the total, where the fit ends
PATIENCE = 50  # rounds without a gain, where it ends too


def _source(column: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))


def sample_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str, sources: list[str], sample: int, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> np.ndarray:
    """sources x FEATURES: counts of hashed token ids in at most `sample` whole texts of each source.

    Of each of `sample` hash buckets of a source the document of the lowest hash. Texts are encoded where they lie; only the counts reach the driver.
    """
    named = docs.select(F.xxhash64(id_col).alias("h"), _source(source_col).alias("label")).filter(F.col("label").isin(*sources))
    chosen = named.groupBy("label", F.pmod("h", F.lit(sample)).alias("bucket")).agg(F.min("h").alias("h")).select("label", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = encoder(folder, name).encode, np.zeros((len(sources), FEATURES), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.add.at(counts[sources.index(label)], np.asarray(encode(text), np.int64) * 2654435761 % (1 << 32) % FEATURES, 1)
        s, f = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(counts[s, f])], ["s", "f", "n"])

    texts = docs.select(F.xxhash64(id_col).alias("h"), _source(source_col).alias("label"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    # Bounded: `sample` rows of each source on one side, FEATURES counts of each at the end.
    picked = texts.join(F.broadcast(chosen), ["label", "h"]).select("label", "text").mapInArrow(run, "s int, f int, n bigint")
    result = np.zeros((len(sources), FEATURES))
    for row in picked.groupBy("s", "f").agg(F.sum("n").alias("n")).collect():
        result[row.s, row.f] = row.n
    return result


def fit_sources(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of the features of each source, smoothed; a source without texts is uniform."""
    counts = counts + 0.5
    return np.log(counts / counts.sum(1, keepdims=True))


def posteriors(ids: list[int], table: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Posterior of each source, in parts of GRID that add up to GRID."""
    log = np.log(prior)
    if ids:
        seen = table[:, np.asarray(ids, np.int64) * 2654435761 % (1 << 32) % FEATURES]
        log = log + seen.sum(1) * min(1.0, EVIDENCE / len(ids))
    p = np.exp(log - log.max())
    exact = p / p.sum() * GRID
    parts = np.floor(exact).astype(int)
    for k in np.argsort(parts - exact, kind="stable")[: GRID - parts.sum()]:
        parts[k] += 1
    return parts


def sized(docs: DataFrame, table: np.ndarray, sources: list[str], prior: list[float], limits: list[int], id_col: str, text_col: str, source_col: str, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> DataFrame:
    """(id, source, tokens, member array<int>, cap): tokens of each whole text; membership of the sources in parts of GRID. Narrow.

    A stated source is the membership; documents without one get posteriors, and the limit of their likeliest source. Documents of other
    sources have no membership.
    """
    shares = np.maximum(np.asarray(prior, float), 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, name)
        for batch in batches:
            tokens, member, caps = [], [], []
            for source, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if source in sources:
                    tokens.append(own.count(text) if text else 0)
                    member.append([GRID if s == source else 0 for s in sources])
                    caps.append(limits[sources.index(source)])
                elif source is None:
                    ids = own.encode(text) if text else []
                    parts = posteriors(ids, table, shares)
                    tokens.append(len(ids))
                    member.append(parts.tolist())
                    caps.append(limits[int(parts.argmax())])
                else:
                    tokens.append(own.count(text) if text else 0)
                    member.append(None)
                    caps.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(member, pa.list_(pa.int32())), pa.array(caps, pa.int32())], ["id", "source", "tokens", "member", "cap"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), _source(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, source string, tokens bigint, member array<int>, cap int")


def fitted(member: np.ndarray, cap: np.ndarray, tokens: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The rate of each bundle (member: bundles x sources, in parts of 1): projected gradient on the squared distance between
    the expected token totals of the sources and the largest totals in the shares that the limits allow, until it no longer falls.

    Sources without any text are left out, the others keep their proportions.
    """
    weight = member * tokens[:, None]
    room, mass = (weight * cap[:, None]).sum(0), weight.sum(0)
    wanted = (shares > 0) & (room > 0)
    if not wanted.any():
        return np.zeros(len(tokens))
    share = np.where(wanted, shares, 0.0) / shares[wanted].sum()
    total = (room[wanted] / share[wanted]).min()
    rate, best, last, idle = np.zeros(len(tokens)), np.zeros(len(tokens)), np.inf, 0
    while idle < PATIENCE:
        residual = rate @ weight - total * share
        distance = np.abs(residual).max()
        if distance < last * (1 - 1e-6):
            best, idle = rate, 0
            last = distance
        else:
            idle += 1
        if distance <= TOLERANCE * total:
            break
        # The gradient, scaled by each source's mass.
        step = np.where(mass > 0, residual / np.maximum(mass, 1.0), 0.0)
        rate = np.clip(rate - member @ step, 0.0, cap)
    return best


def rates(bundles: DataFrame, shares: np.ndarray) -> DataFrame:
    """(bundle, tokens, rate) of bundles (bundle, member, cap, tokens).

    Documents of equal membership and limit have equal gradients, so that rounds over their bundles are rounds over all documents. Memberships
    are in parts of GRID and a limit belongs to a source: the bundles are bounded by the numbers of these, whatever the corpus, and fit one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if kept := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(kept)
            member = np.array(table.column("member").to_pylist(), float) / GRID
            rate = fitted(member, table.column("cap").to_numpy().astype(float), table.column("tokens").to_numpy().astype(float), shares)
            yield from pa.table({"bundle": table.column("bundle"), "tokens": table.column("tokens"), "rate": pa.array(rate)}).to_batches()

    return bundles.select("bundle", "member", "cap", "tokens").repartition(1).mapInArrow(run, "bundle string, tokens bigint, rate double")


def _mix(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, sample: int, folder: str, name: str) -> tuple[DataFrame, list[str]]:
    """(id, source, tokens, member, copies) of every document with at least one copy, and the sources in the order of member."""
    spark = docs.sparkSession
    wanted = sorted((r.source, float(r.target_share), int(r.max_repeats)) for r in targets.select(_source("source").alias("source"), "target_share", "max_repeats").dropna().collect())
    if not wanted:
        return spark.createDataFrame([], "id bigint, source string, tokens bigint, member array<int>, copies int"), []
    ship(spark, folder, name)
    sources, limits = [w[0] for w in wanted], [w[2] for w in wanted]
    shares = np.array([w[1] for w in wanted])
    shares = shares / shares.sum() if shares.sum() else shares
    table = fit_sources(sample_counts(docs, id_col, text_col, source_col, sources, sample, folder, name))
    rows = written(sized(docs, table, sources, shares.tolist(), limits, id_col, text_col, source_col, folder, name), "mix-sizes").filter("member is not null and tokens > 0")
    keyed = rows.withColumn("bundle", F.concat_ws(",", F.transform("member", lambda x: x.cast("string")), F.col("cap").cast("string")))
    bundles = keyed.groupBy("bundle").agg(F.first("member").alias("member"), F.first("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    whole = F.floor(F.col("rate") + 1e-9)
    plan = written(rates(bundles, shares).select("bundle", whole.cast("int").alias("whole"), F.round(F.greatest(F.col("rate") - whole, F.lit(0.0)) * F.col("tokens")).cast("bigint").alias("need")), "mix-plan")
    hashed = keyed.withColumn("h", F.xxhash64("id"))
    cut = cutoffs(hashed.select("bundle", "h", "tokens"), plan.select("bundle", "need"), "bundle", "h", "tokens", 1024)
    # The document on the cutoff is in if that comes nearer.
    rule = plan.join(cut, "bundle", "left").withColumn("last", F.expr("2 * (need - below) >= at"))
    extra = F.when((F.col("need") <= 0) | F.col("need").isNull(), 0).when(F.col("cutoff").isNull(), 1).when((F.col("h") < F.col("cutoff")) | ((F.col("h") == F.col("cutoff")) & F.col("last")), 1).otherwise(0)
    used = hashed.join(rule, "bundle").withColumn("copies", (F.col("whole") + extra).cast("int"))
    return used.filter("copies > 0").select("id", "source", "tokens", "member", "copies"), sources


def mixed(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sample: int = SAMPLE, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> DataFrame:
    """(id, source, tokens, copies) of every document with at least one copy.

    targets: source, target_share, max_repeats (a small fixed table; shares need not add up to 1). Documents of sources outside targets and texts without
    tokens aren't used. Repeated rows of one id are settled alike. A target source without any text is left out and the others are mixed in their proportions.
    """
    found, _ = _mix(docs, targets, id_col, text_col, source_col, sample, folder, name)
    return found.select(F.col("id").alias(id_col), "source", "tokens", "copies")


def reached_shares(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sample: int = SAMPLE, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, reached_share, most_copies) of each target source.

    n_tokens are the expected tokens of all copies by membership: documents without a stated source count in parts, n_docs and
    most_copies are of those that state it. A source without any text has 0 of all.
    """
    found, sources = _mix(docs, targets, id_col, text_col, source_col, sample, folder, name)
    parts = [F.coalesce(F.sum(F.col("tokens") * F.col("copies") * F.get("member", F.lit(k))) / GRID, F.lit(0.0)).alias(f"t{k}") for k in range(len(sources))]
    stated = [e for k, s in enumerate(sources) for e in (F.count(F.when(F.col("source") == s, 1)).alias(f"n{k}"), F.max(F.when(F.col("source") == s, F.col("copies"))).alias(f"m{k}"))]
    row = found.agg(F.count("*"), *parts, *stated).first()
    total = sum(row[f"t{k}"] for k in range(len(sources)))
    report = [(s, row[f"n{k}"], float(row[f"t{k}"]), row[f"t{k}"] / total if total else 0.0, row[f"m{k}"]) for k, s in enumerate(sources)]
    reached = docs.sparkSession.createDataFrame(report, "source string, n_docs bigint, n_tokens double, reached_share double, most_copies int")
    named = targets.select(_source("source").alias("source"), "target_share", "max_repeats")
    return named.join(reached, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_tokens", "reached_share", "most_copies")])
